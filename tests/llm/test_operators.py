"""Operators of the llm subpackage on small fixtures: against brute force, round trips, and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from oddsmill.llm import ann, grace_dedup, language_id, mixing, near_dup, packing, quality, secret_scan, token_store, warc  # noqa: E402
from oddsmill.llm.common import ChunkedTokenizer, scratch_path  # noqa: E402
from oddsmill.llm.oracles import ORACLES  # noqa: E402
from oddsmill.llm.queries import QUERIES  # noqa: E402
from tests.compare import assert_same  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 8000
#: Nulls in any column, empty and very long texts, ties and repeated rows, and columns that clash with internal names.
ODD = [
    (1, "one two three four five six", "en", "a", 0),
    (2, "one two three four five six", "en", None, 0),
    (2, "one two three four five six", "en", None, 0),
    (3, None, "fr", "a", 0),
    (4, "", None, "b", 0),
    (5, "   ", None, "b", 0),
    (6, LONG, "en", None, 0),
    (7, "word", "en", "a", 0),
    (None, "no id at all", "en", "c", 0),
    (8, "été çà 東京 \x1c 42", "fr", "c", 0),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, SHAPE)
    for clash in ("uid", "size", "content", "bands", "rep", "key", "score", "start", "h_", "blob", "path", "digest", "row", "i", "h", "node", "position", "copy", "copies", "spot", "skey", "b1", "b2", "taken", "kept", "key_", "k_", "c_"):
        df = df.selectExpr("*", f"'x' as {clash}")
    return df


def none(spark):
    return odd(spark).where("1 = 0")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_meets_its_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


# 1: mixing


def mixed(spark, df):
    sized = mixing.sized_documents(df)
    return mixing.mix(sized, mixing.rank_schedule(mixing.sources_of(sized)))


def test_mixing_odd_rows(spark):
    rows = mixed(spark, odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"]) for r in rows)
    assert all(0 <= c["position"] <= 1 for r in rows for c in r["copies"])
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in ODD)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * total, abs=4)
    assert mixed(spark, none(spark)).count() == 0


def test_water_filling_reshares_until_none_is_above(spark):
    sizes = {"va": 100, "vb": 10, "vc": 1000, "vd": 5, "z": 400}
    s = spark.createDataFrame(list(sizes.items()), "skey string, source_size long")
    w = mixing.integrate(mixing.rank_schedule(s))
    weights = {r["skey"]: r["weight"] for r in w.collect()}
    assert [weights[k] for k in sorted(sizes)] == [3.0, 1.0, 2.0, 3.0, 1.0]
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * level > 2 * sizes[k]}
        for k in full or open_:
            target[k] = 2 * sizes[k] if full else weights[k] * level
            left -= target[k] if full else 0
        open_ = open_ - full if full else set()
    got = {r["skey"]: r["target"] for r in mixing.share_out(s, w, 1.5, 2.0).collect()}
    assert got == pytest.approx(target)


def test_positions_invert_the_integrated_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "s", 0) for i in range(400)], SHAPE)
    got = sorted(c["position"] for r in mixed(spark, docs).collect() for c in r["copies"])
    # one source, shape 1.5 to 0.5: by t, the share of demand is 1.5 t - t^2 / 2
    for i, t in enumerate(got):
        assert 1.5 * t - 0.5 * t * t == pytest.approx(i / len(got), abs=1e-6)


def test_training_order_is_a_range_sort(spark):
    df = spark.createDataFrame([(i, (i * 37 % 100) / 100) for i in range(100)], "doc_id long, position double")
    assert [r["position"] for r in mixing.training_order(df).collect()] == [i / 100 for i in range(100)]


def test_mixed_documents_repeat_and_cut(spark):
    docs = spark.createDataFrame([(i, f"a{i}  b c\nd", "en", "s" + str(i % 3), 99) for i in range(30)], SHAPE)
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in out) == pytest.approx(1.5 * 120, abs=3)
    assert max(Counter(r["doc_id"] for r in out).values()) == 2
    assert all(f"a{r['doc_id']}  b c\nd".startswith(r["text"]) for r in out)


def test_mixed_documents_are_whole(spark):
    sizes = [7, 3, 50, 1, 12, 30, 5, 9, 40, 2]
    docs = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(n)), "en", f"s{i % 2}", 99) for i, n in enumerate(sizes * 3)], SHAPE)
    for share in (0.13, 0.37, 0.8, 1.3):
        out = mixing.mixed_documents(docs, share=share).collect()
        assert out and all(len(r["text"].split()) == (sizes * 3)[r["doc_id"]] and r["n_chars"] == 99 for r in out)
        assert abs(sum(len(r["text"].split()) for r in out) - share * sum(sizes) * 3) <= 2 * 25 + 2


def test_mixed_documents_odd_rows(spark):
    df = odd(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, had = Counter(map(tuple, out.collect())), Counter(map(tuple, df.collect()))
    assert set(got) <= set(had) and all(n <= 2 * had[r] for r, n in got.items())
    assert all(r[1] and r[1].strip() for r in got) and any(r[0] is None for r in got)
    assert mixing.mixed_documents(none(spark)).count() == 0


# 2 and 10: tokens

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def encoded(file, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module", params=[BYTE, WORDS])
def chunked(request):
    return ChunkedTokenizer(request.param, kept=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,.'s\n\t 1é²\xa0\x1c\x85!|dΣ\0<|>"), max_size=30), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(chunked, texts):
    whole = [e.ids for e in chunked.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in chunked(texts)] == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|END|>", "<|", "|>", "endoftext", "a", "é", " ", "\n", ".", "'s"]), max_size=9).map("".join), max_size=4))
def test_names_of_special_tokens_get_the_ids_of_the_library(chunked, request, texts):
    from tokenizers import Tokenizer

    as_loaded = Tokenizer.from_file(request.node.callspec.params["chunked"])
    assert [np.frombuffer(b, "<u4").tolist() for b in chunked(texts)] == [as_loaded.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, encoding):
    path = scratch_path(spark, "t")
    rows = [*ODD, (9, "before <|endoftext|> and after", "en", "c", 0)]
    token_store.write_tokens(odd(spark, rows), path, BYTE, encoding=encoding)
    want = sorted(((r[0], encoded(BYTE, r[1])) for r in rows), key=repr)
    rows = token_store.read_tokens(spark, path).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=repr) == want
    assert sorted(r["ids"] for r in token_store.read_tokens(spark, path, ["ids"], (1, 2)).collect()) == sorted(x for i, x in want if i in (1, 2))
    start = 0
    for r in sorted(token_store.token_digests(spark, path).collect(), key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    crcs = Counter(zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want)
    assert Counter(r["ids_crc32"] for r in token_store.token_digests(spark, path).collect()) == crcs


def test_token_files_prune_and_index(spark, tmp_path):
    path = str(tmp_path / "t")
    token_store.write_tokens(spark.createDataFrame([(i, f"text {i} " * 50) for i in range(3000)], "doc_id long, text string"), path, BYTE)
    plan = token_store.read_tokens(spark, path, ["doc_id", "n_tokens"], (5, 9))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,5)" in plan
    import glob

    import pyarrow.parquet as pq

    chunk = pq.ParquetFile(glob.glob(path + "/part-*")[0]).metadata.row_group(0).column(4)
    assert chunk.has_column_index or chunk.has_offset_index
    assert "RLE_DICTIONARY" in chunk.encodings or "PLAIN_DICTIONARY" in chunk.encodings


def test_empty_token_table(spark):
    path = scratch_path(spark, "t")
    token_store.write_tokens(none(spark), path, BYTE)
    assert token_store.token_digests(spark, path).count() == 0


def check_packing(rows, want, window=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["token_bytes"])
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    for doc, ids in want.items():
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["token_bytes"] for r in pieces), "<u4").tolist() == ids
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    return [sum(r["length"] for r in s) for s in by_seq.values()]


def test_ids_are_joined_without_an_index_of_each():
    """Beside the ids themselves little memory is taken, also of pieces with many ids."""
    import tracemalloc

    encode, texts = ChunkedTokenizer(BYTE), [" ".join(["Donaudampfschifffahrtsgesellschaft"] * 20_000)]
    want = encode(texts)
    tracemalloc.start()
    got = encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and peak <= 4 * len(got[0])


def test_packing_odd_rows(spark):
    rows = [r for i, r in enumerate(ODD) if i != 2]
    fills = check_packing(packing.pack_documents(odd(spark, rows).coalesce(1), WORDS).collect(), {r[0]: encoded(WORDS, r[1]) for r in rows})
    assert all(f == 4096 or f & (f - 1) == 0 for f in fills)
    assert packing.pack_documents(none(spark), WORDS).count() == 0
    assert packing.pack_documents(odd(spark), WORDS).where("doc_id = 2").count() >= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=150), st.integers(1, 12))
def test_packer_places_every_id_once(sizes, most_open):
    p = packing.Packer(window=32, most_open=most_open)
    want = {}
    for i, n in enumerate(sizes):
        want[i] = list(range(100 * i, 100 * i + n))
        p.add(i, np.array(want[i], "<u4").tobytes())
    p.finish()
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_bytes")
    fills = check_packing([dict(zip(names, r, strict=True)) for r in p.done], want, 32)
    assert all(f & (f - 1) == 0 for f in fills) and sum(f < 32 for f in fills) <= 5


def test_packer_takes_the_level_with_the_least_sum_of_squares():
    p = packing.Packer(window=10)
    for level, n in ((3, 4), (4, 1), (6, 2)):
        for _ in range(n):
            p._put(level, [])
    for size in range(1, 10):
        cost = {}
        for h in [0, *np.flatnonzero(p.counts)]:
            if h + size <= 10:
                after = p.counts.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 10
                cost[int(h)] = int((after[1:10] ** 2).sum())
        best = min(cost.values())
        assert p.level_for(size) == max(h for h, v in cost.items() if v == best)


# 3: near duplicates


def shingles(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rng = np.random.default_rng(5)
    rows, base = [], [[f"w{rng.integers(0, 5000)}" for _ in range(120)] for _ in range(12)]
    for i in range(150):  # chains of small edits, so that components go beyond direct links
        words = list(base[i % 12])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 120))] = f"w{rng.integers(0, 5000)}"
        if i % 3 == 0:
            base[i % 12] = words
        rows.append((i, " ".join(words).upper() if i % 2 else " ".join(words), None, None, 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_dup_groups(odd(spark, rows), width, percent).collect()}
    assert got == brute_components(rows, width, percent)
    assert len({c for _, c in got.values()}) < 150


def test_near_duplicates_odd_rows(spark):
    rows = near_dup.near_dup_groups(odd(spark), 3, 85).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["component_id"], by[2]["component_id"], by[2]["kept"]) == (1, 1, False)
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] and by[i]["component_id"] == i for i in (3, 4, 5))
    assert by[7]["n_shingles"] == 1 and by[6]["n_shingles"] == 5 and by[None]["kept"]
    assert near_dup.near_dup_groups(none(spark)).count() == 0
    left = near_dup.one_of_each_group(odd(spark))
    assert left.columns == odd(spark).columns and left.schema == odd(spark).schema
    assert sorted((r["doc_id"] or 0, r["uid"]) for r in left.collect()) == [(i, "x") for i in (0, 1, 3, 4, 5, 6, 7, 8)]
    assert near_dup.one_of_each_group(none(spark)).count() == 0


def test_ids_that_repeat_with_other_texts_are_judged_by_text(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(1, a, None, None, 0), (3, a + " z", None, None, 0), (3, b, None, None, 0), (4, b, None, None, 0), (3, c, None, None, 0)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_dup_groups(odd(spark, rows), 5, 80).collect()}
    assert got == {(1, 36, 1, True), (3, 37, 1, False), (3, 36, 3, True), (4, 36, 3, False)}
    assert sorted((r["doc_id"], r["text"][0]) for r in near_dup.one_of_each_group(odd(spark, rows)).collect()) == [(1, "a"), (3, "b"), (3, "c")]


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "PART", 4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]]), None, None, 0) for i in range(40)]
    assert {r["component_id"] for r in near_dup.near_dup_groups(odd(spark, rows), 3, 85).collect()} == {0}


@pytest.mark.parametrize(("few", "block"), [(1, 3), (2, 64), (8, 2)])
def test_groups_in_one_bucket_stay_apart(spark, monkeypatch, few, block):
    """Many documents share three quarters of their words, so buckets hold several groups; links within groups are all found."""
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    common, rows = [f"c{i}" for i in range(90)], []
    for g in range(6):
        own = [f"g{g}x{i}" for i in range(30)]
        for m in range(5):
            rows.append((5 * g + m, " ".join([*common, *own[:-1], f"m{g}{m}"]), None, None, 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_dup_groups(odd(spark, rows), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85) and len({c for _, c in got.values()}) == 6


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abC \t\né漢\x1c"), max_size=60), st.integers(1, 5))
def test_shingle_counts(text, width):
    assert len(near_dup.shingle_set(text, width)) == len(shingles(text, width))


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dup.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_buckets_of_one_group_share_centres(spark):
    """200 buckets, each of a random half of 400 members: pairs are a few for each member, and each bucket hangs together by its own."""
    rng = np.random.default_rng(8)
    buckets = [np.flatnonzero(rng.random(400) < 0.5).tolist() for _ in range(200)]
    members = spark.createDataFrame([(k, len(b), i) for k, b in enumerate(buckets) for i in b], "key long, n long, node long")
    pairs = {(r["centre"], r["node"]) for r in near_dup.first_pairs(members).collect()}
    assert len(pairs) <= 30 * 400
    for b in buckets:
        assert all((b[0], i) in pairs for i in b[1:])
        assert any(all((c, i) in pairs for i in b if i != c) for c in b[1:])


# 4 and 5: classifiers


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        m = language_id.codewords(n)
        assert len({tuple(r) for r in m}) == n


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_both_systems_give_the_same_weights_and_left_out_predictions():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 20)), rng.choice([-1.0, 1.0], (60, 3))
    w, left_out = language_id.ridge(x, y)  # more rows than features: by features
    inverse = np.linalg.inv(x @ x.T + language_id.RIDGE * np.eye(60))
    assert np.allclose(w, x.T @ inverse @ y)
    for i in range(60):
        rest = np.arange(60) != i
        alone = np.linalg.solve(x[rest].T @ x[rest] + language_id.RIDGE * np.eye(20), x[rest].T @ y[rest])
        assert np.allclose(left_out[i], x[i] @ alone)
    few, few_out = language_id.ridge(x[:10], y[:10])  # fewer: by rows
    assert np.allclose(few, np.linalg.solve(x[:10].T @ x[:10] + language_id.RIDGE * np.eye(20), x[:10].T @ y[:10]))
    alone = np.linalg.solve(x[1:10].T @ x[1:10] + language_id.RIDGE * np.eye(20), x[1:10].T @ y[1:10])
    assert np.allclose(few_out[0], x[0] @ alone)


def test_learning_rows_are_bounded_for_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_ROWS", 300)
    rows = [(i, f"word{i % 30} of language {chr(97 + i % 30)}", f"l{i % 30:02}") for i in range(6000)]
    docs, sizes, fit = spark.createDataFrame(rows, "doc_id long, text string, lang string"), [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, langs: sizes.append(len(x)) or fit(x, langs))
    model = language_id.learn(docs, F.lit(True))
    assert len(model["names"]) == 30 and 200 < sizes[0] < 400


def test_learning_rows_are_bounded_for_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_ROWS", 120)
    monkeypatch.setattr(language_id, "QUOTA", 50)
    seen, fit = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, langs: seen.append(dict(__import__("collections").Counter(langs))) or fit(x, langs))
    learn = lambda rows: language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert learn([(7, "the same words", "aa")] * 20_000 + [(i, f"other words {i}", "bb") for i in range(5)])["names"] == ["aa", "bb"]
    assert seen.pop() == {"aa": 1, "bb": 5}
    learn([(7, f"one id, text {i}", "aa") for i in range(2000)] + [(None, f"no id, text {i}", "bb") for i in range(2000)])
    assert all(40 <= n <= 50 for n in seen.pop().values())
    learn([(None, "nothing else", "aa")] * 3000)
    assert seen.pop() == {"aa": 1}
    learn([(i, f"text {i}", f"l{i % 10_000}") for i in range(10_000)] + [(i, f"more {i}", "l77") for i in range(10)])
    assert sum((got := seen.pop()).values()) == 120 and max(got.values()) == 1 and "l77" in got


def test_language_odd_rows(spark):
    from pyspark.sql import functions as F

    df = odd(spark)
    model = language_id.learn(df, F.lit(True))
    rows = language_id.identify(df, model).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by[3] == by[4] == by[5] == "und" and by[1] == "en"
    assert language_id.learn(none(spark), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.identify(none(spark), model).count() == 0
    one = language_id.learn(df.where("lang = 'en'"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(df, one).collect()} == {"en", "und"}
    assert language_id.known_only(df, model).columns == df.columns
    assert language_id.known_only(df, None).count() == 0


def test_ambiguous_documents_stay(spark):
    model = language_id.fit(np.eye(4, language_id.BUCKETS, dtype=np.float32), ["a", "b", "c", "d"])
    model["w"] = model["w"] * 0
    docs = spark.createDataFrame([(1, "mixed words", "en", "s", 11), (2, "12 !", "en", "s", 4), (3, None, "en", "s", 0)], SHAPE)
    assert [r["ambiguous"] for r in language_id.identify(docs, model).collect()] == [True] * 3
    assert [r["doc_id"] for r in language_id.known_only(docs, model).collect()] == [1]


def test_ambiguity_is_flagged():
    model = language_id.fit(np.eye(4, language_id.BUCKETS, dtype=np.float32), ["a", "b", "c", "d"])
    assert language_id.decode(np.zeros(7), model)[2]
    assert not language_id.decode(model["code"][2] * 1.0, model)[2] and language_id.decode(model["code"][2] * 1.0, model)[0] == "c"


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = (np.array([r["score"] for r in rows if r["quality"] == q]) for q in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_quality_odd_rows(spark):
    from pyspark.sql import functions as F

    stats = quality.statistics_table(odd(spark))
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, None), (None, 1), (7, 1)], "doc_id long, quality int")
    model = quality.learn(stats, labels, F.lit(True), F.lit(1))
    assert all(0 <= r["score"] <= 1 for r in quality.score(stats, model).collect())
    nothing = quality.learn(stats, labels.where("1 = 0"), F.lit(True), F.lit(1))
    assert nothing is None and {r["score"] for r in quality.score(stats, None).collect()} == {0.5}
    assert quality.score(quality.statistics_table(none(spark)), model).count() == 0


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 9)), min_size=1, max_size=30))
def test_pooling_is_monotone_and_keeps_the_mean(pairs):
    v, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    means, _ = quality.pool(v, w)
    assert (np.diff(means) >= -1e-9).all() and (means * w).sum() == pytest.approx((v * w).sum())


# 6: secrets


def test_secrets_odd_rows_and_ledger(spark):
    key = "AKIA" + "Q7" * 8
    rows = [(1, f'x password = "hunter22" {key}', None, None, 0), (2, f'x password = "hunter22" {key}', None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (5, "é" * 50_000 + " token: abcdef" + "0a" * 12, None, None, 0), (None, "secret=token: abcdefgh", None, None, 0)]
    ledger = scratch_path(spark, "ledger")
    first = {r["path"]: r for r in secret_scan.scan(odd(spark, rows).drop("path"), ledger, path_col="doc_id", text_col="text").collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in first[1]["spans"]] == [("assign", 2, 22), ("access", 24, 44)]
    assert first[1]["spans"] == first[2]["spans"] and first[3]["spans"] == first[4]["spans"] == []
    assert [(s["kind"], s["start"]) for s in first[5]["spans"]] == [("assign", 50_001), ("hex", 50_008)]
    assert first[None]["spans"] == []  # the short match takes up the second keyword
    n = spark.read.parquet(ledger).count()
    again = secret_scan.scan(odd(spark, [*rows, (9, "api_key='zzzzzz'", None, None, 0)]).drop("path"), ledger, path_col="doc_id", text_col="text")
    assert again.count() == 7
    assert spark.read.parquet(ledger).count() == n + len(secret_scan.RULES)  # one new blob, all its rules
    newer = (*secret_scan.BASE_RULES, secret_scan.Rule("pem", 3, "-----BEGIN", version=2))
    secret_scan.scan(odd(spark, rows).drop("path"), ledger, newer, path_col="doc_id", text_col="text").count()
    added = spark.read.parquet(ledger)
    assert added.where("rule = 'pem@2'").count() == 4 and added.count() == n + len(secret_scan.RULES) + 4
    assert secret_scan.scan(none(spark).drop("path"), scratch_path(spark, "ledger"), path_col="doc_id", text_col="text").count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 129, 20_000])
def test_secrets_many_in_one_text(spark, n):
    """Runs of matches join without gap: positions as a plain scan of the text gives them."""
    text = "é😀 ".join(f"token: v{'x' * (i % 9)} {'0a' * (10 + i % 5)}" for i in range(n)) + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secret_scan.scan(docs, scratch_path(spark, "ledger"), path_col="doc_id", text_col="text").first()["spans"]
    want = []
    for r in secret_scan.BASE_RULES:
        want += [(m.start(), r.rank, r.kind, m.end()) for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
    assert [tuple(s) for s in got] == sorted(want)


# 7: nearest neighbours


def test_nearest_odd_rows_and_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:340] = x[0]  # equal vectors
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] * 16, 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [1.0], 0), (None, [1.0] * 16, 0), (20, x[20].tolist(), 9)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x64, hits = x.astype(float), 0
    for q in range(0, 700, 20):
        s = x64 @ x64[q]
        best = [int(i) for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        hits += len(set(best) & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and q not in [i for i, _ in got[q]]
        assert [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        assert all(v == pytest.approx(s[i]) for i, v in got[q])
    assert hits / (35 * 20) >= 0.9 and set(got) == set(range(0, 700, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, score int")
    assert ann.search(few, F.col("vec_id") % 20 == 0).count() == 2
    assert ann.search(few.where("1 = 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_copies_and_repeated_ids_take_no_places(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[0] = [1] + [0] * 15
    x[1:31] = x[0] * 3 + rng.normal(size=(30, 16)).astype(np.float32) * 0.02  # true neighbours of 0
    x[31:1500] = x[0] * 2.9  # one group just behind them
    x[1500:] /= np.linalg.norm(x[1500:], axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2999, x[2999].tolist())] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id").isin(0, 40, 2999), metric=metric).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    x64 = x.astype(float)
    for q in (0, 40, 2999):
        s = x64 @ x64[q] if metric == "ip" else -((x64 - x64[q]) ** 2).sum(1)
        best = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert len(got[q]) == len(set(got[q])) == 20 and len(set(best) & set(got[q])) >= (18 if q < 2000 else 15)


@pytest.mark.parametrize("spread_", [1.0, 0.05])
def test_cells_are_probed_as_far_as_recall_needs(spark, monkeypatch, spread_):
    """With vectors in all directions most cells are probed, with clusters few; packs, blocks and stripes are small and many."""
    for name, value in (("SCAN", 100), ("PACK", 128), ("BLOCK", 16), ("STRIPES", 3), ("KEPT", 200)):
        monkeypatch.setattr(ann, name, value)
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + spread_ * rng.normal(size=(3000, 16))) * 1e100  # doubles beyond float
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 50):
        s = x @ x[q]
        best = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        hits += len(set(best) & {i for i, _ in got[q]})
        assert all(v == pytest.approx(s[i]) for i, v in got[q])
    assert hits / (60 * 20) >= 0.9


def vectors_of(kind, rng):
    x = rng.normal(size=(3000, 192 if kind == "wide" else 24))
    if kind == "lengths":
        x *= np.exp(2 * rng.normal(size=(3000, 1)))
    if kind == "one far":
        x[7] *= 1e15
    if kind == "tight":
        x = rng.normal(size=(3, 24))[rng.integers(0, 3, 3000)] + 1e-4 * x
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize(("kind", "metric"), [("wide", "ip"), ("lengths", "ip"), ("one far", "ip"), ("tight", "l2")])
def test_nearest_are_found_where_codes_are_coarse(spark, kind, metric):
    """All rows are looked at, so none of the true neighbours may be missing, and scores are those of a fold in double precision."""
    x = vectors_of(kind, np.random.default_rng(6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, metric=metric).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    inner = lambda a: np.cumsum(a, axis=1)[:, -1]
    for q in range(0, 3000, 100):
        s = inner(x * x[q]) if metric == "ip" else 2 * inner(x * x[q]) - inner(x * x) - inner(x[q : q + 1] ** 2)
        best = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert got[q] == [(i, s[i]) for i in best]


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_nearest_recall_on_the_table(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = QUERIES["op7_nearest"](spark, d).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits, total = hits + len(set(best) & set(got[got["query_id"] == q]["vec_id"])), total + 20
    assert hits / total >= 0.9


# 8: exact copies


def test_exact_odd_rows(spark):
    rows = grace_dedup.exact_dedup(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [(r["keep_id"], r["group_size"]) for r in by[1]] == [(2, 3)] and sum(r["kept"] for r in by[2]) == 1
    assert by[3][0]["keep_id"] == 4 and by[3][0]["group_size"] == 2 and by[4][0]["kept"]
    assert by[None][0]["kept"] and by[6][0]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert grace_dedup.exact_dedup(none(spark)).count() == 0
    left = grace_dedup.without_copies(odd(spark))
    assert left.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 4, 5, 6, 7, 8]


def test_grace_recursion_gives_the_same_groups():
    rng = np.random.default_rng(1)
    texts = [b"%d" % rng.integers(0, 300) * int(rng.integers(1, 3)) for _ in range(4000)]
    rows = [(i, hashlib.sha256(t).digest(), 1, i, i, t) for i, t in enumerate(texts)]
    schema = pa.schema([("leader", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("top", pa.int64()), ("top_uid", pa.int64()), ("content", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 100], strict=True), schema, strict=True)], schema=schema) for k in range(0, 4000, 100)]
    want, last = Counter(texts), {t: i for i, t in enumerate(texts)}
    for budget in (1 << 30, 20_000, 500):
        got = {}
        for b in grace_dedup.grace(batches, table_bytes=budget, ways=4):
            got |= {r["leader"]: (r["keep_id"], r["group_size"]) for r in b.to_pylist()}
        assert got == {i: (last[t], want[t]) for i, t in enumerate(texts)}


def test_one_text_from_many_tasks_takes_the_memory_of_one(spark):
    text, n = b"x" * 100_000, 10_000
    schema = pa.schema([("leader", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("top", pa.int64()), ("top_uid", pa.int64()), ("content", pa.binary())])
    sha = hashlib.sha256(text).digest()
    stream = (pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([i], [sha], [3], [i], [i], [text]), schema, strict=True)], schema=schema) for i in range(n))
    before, most = pa.total_allocated_bytes(), 0

    def watched():
        nonlocal most
        for b in stream:
            most = max(most, pa.total_allocated_bytes() - before)
            yield b

    got = [r for b in grace_dedup.grace(watched(), table_bytes=150_000) for r in b.to_pylist()]
    assert len(got) == n and {(r["keep_id"], r["group_size"]) for r in got} == {(n - 1, 3 * n)} and most < 2_000_000


def test_contents_whose_hashes_agree_are_still_settled():
    schema = pa.schema([("leader", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("top", pa.int64()), ("top_uid", pa.int64()), ("content", pa.binary())])
    rows = [(i, b"\0" * 32, 1, i, i, b"%d" % (i % 40) * 20) for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    got = {r["leader"]: (r["keep_id"], r["group_size"]) for b in grace_dedup.grace([batch], table_bytes=300) for r in b.to_pylist()}
    assert got == {i: (80 + i % 40, 3) for i in range(120)}


def test_table_compares_content_beyond_hashes():
    t = grace_dedup.ContentTable()
    assert [t.place(7, c) for c in (b"a", b"b", b"a")] == [(0, True), (1, True), (0, False)]
    assert [t.place(i % 5, b"%d" % i)[1] for i in range(500)] == [True] * 500


# 9: archives


def archive(payloads, packed=True):
    out, at = b"", []
    for i, p in enumerate(payloads):
        at.append(len(out))
        r = warc.record(i, f"http://x/{i}", p, warc.base32_sha1(p), len(p), None, "2020-01-01T00:00:00Z")
        out += warc.member(r) + warc.member(warc.CLOSE) if packed else r + warc.CLOSE
    return out, [*at, len(out)]


PAYLOADS = [b"first", b"", "é WARC/1.1 inside\r\n\r\n".encode() * 50, bytes(range(256)) * 20, b"last"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_sound_archives(packed):
    found = list(warc.salvage(archive(PAYLOADS, packed)[0]))
    assert [k for k, *_ in found] == ["record"] * 5
    assert [warc.payload_of(*what) for *_, what in found] == PAYLOADS
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("victim", range(5))
def test_salvage_recovers_all_but_the_damaged(packed, victim):
    data, at = archive(PAYLOADS, packed)
    broken = bytearray(data)
    middle = at[victim] + 60 if packed else data.index(b"HTTP/1.1", at[victim])  # where a check covers it
    broken[middle : middle + 6] = b"\xff\x00\xff\x00\xff\x00"
    found = list(warc.salvage(bytes(broken)))
    got = [warc.payload_of(*what) for kind, *_, what in found if kind == "record"]
    assert got == [p for i, p in enumerate(PAYLOADS) if i != victim]
    gaps = [(o, n) for kind, o, n, _ in found if kind == "gap"]
    assert gaps and all(at[victim] <= o and o + n <= at[victim + 1] for o, n in gaps)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_cut_and_dirty_archives(packed):
    data, at = archive(PAYLOADS, packed)
    cut = list(warc.salvage(data[: at[4] + 40]))
    assert [k for k, *_ in cut] == ["record"] * 4 + ["gap"]
    dirty = list(warc.salvage(data[: at[2]] + b"garbage between records" + data[at[2] :]))
    assert [k for k, *_ in dirty] == ["record"] * 2 + ["gap"] + ["record"] * 3


def tiles(found, size):
    at = 0
    for _, offset, length, _ in found:
        assert offset == at
        at += length
    assert at == size


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("said", [10**7, 40_000, 200, 3, 0])
@pytest.mark.parametrize("victim", [0, 2, 5])
def test_a_wrong_length_costs_one_record(packed, said, victim):
    """Too large or too small a Content-Length: the others are recovered, and gaps and records tile the file."""
    out, payloads = b"", [bytes([65 + i]) * (500 * i + 20) for i in range(6)]
    for i, p in enumerate(payloads):
        r = warc.record(i, "u", p, warc.base32_sha1(p), len(p), None, "2020-01-01T00:00:00Z")
        if i == victim:
            true = r.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0]
            r = r.replace(b"\r\nContent-Length: " + true, b"\r\nContent-Length: %d" % said, 1)
        out += warc.member(r) + warc.member(warc.CLOSE) if packed else r + warc.CLOSE
    found = list(warc.salvage(out))
    assert [warc.payload_of(*w) for k, *_, w in found if k == "record"] == [p for i, p in enumerate(payloads) if i != victim]
    tiles(found, len(out))


def test_members_of_many_records_and_records_of_many_members():
    rs = [warc.record(i, "u", p, warc.base32_sha1(p), len(p), None, "2020-01-01T00:00:00Z") + warc.CLOSE for i, p in enumerate(PAYLOADS)]
    one = warc.member(b"".join(rs))
    found = list(warc.salvage(one + warc.member(rs[0][:50]) + warc.member(rs[0][50:]) + b"dirt" + warc.member(rs[1])))
    assert [k for k, *_ in found] == ["record"] * 6 + ["gap", "record"]
    tiles(found, sum(f[2] for f in found))
    assert [f[2] for f in found[:5]] == [len(one), 0, 0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.booleans(), st.lists(st.tuples(st.floats(0, 1), st.binary(min_size=1, max_size=12)), max_size=3))
def test_any_damage_leaves_a_tiled_file(packed, damage):
    data = bytearray(archive(PAYLOADS, packed)[0])
    for where, what in damage:
        i = int(where * (len(data) - 1))
        data[i : i + len(what)] = what
    found = list(warc.salvage(bytes(data)))
    tiles(found, len(data))
    assert all(warc.payload_of(*w) in PAYLOADS for k, *_, w in found if k == "record")


def test_archives_are_bounded_by_bytes(spark):
    import glob

    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(i, "u", rng.bytes(400).hex()) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, path := scratch_path(spark, "w"), archive_bytes=3000)
    sizes = [len(open(f, "rb").read()) for f in glob.glob(path.removeprefix("file:") + "/*/part-*")]
    assert len(sizes) >= 8 and max(sizes) < 4000
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).where("kind = 'record'").collect()) == list(range(40))


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "u\nv", "<p>x</p>"), (4, "", None), (2, "", ""), (None, "n", "null id"), (7, "z", "é" * 100_000), (8, "y", "same"), (8, "y", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as sha", "2 as keep")
    path = scratch_path(spark, "w")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[1]["payload_bytes"]) == ("revisit", 5, 8) and by[5]["record_type"] == "response"
    assert by[1]["payload_digest"] == by[5]["payload_digest"] == warc.base32_sha1(b"<p>x</p>")
    assert by[2]["refers_to"] == 4 and by[4]["record_type"] == "response" and by[None]["record_type"] == "response"
    assert by[7]["payload"].decode() == "é" * 100_000 and by[3]["target"] == "u%0Av"
    warc.write_archives(pages.where("1 = 0"), empty := scratch_path(spark, "w"))
    assert warc.read_archives(spark, empty).count() == 0
