"""Filter audit, URL filter and spelling variants on small fixtures: against brute force and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from oddsmill.llm import filter_audit, spelling, url_filter  # noqa: E402
from oddsmill.llm.oracles import ORACLES  # noqa: E402
from tests.compare import assert_same  # noqa: E402
from tests.llm.test_operators import none, odd  # noqa: E402

# 11: filter audit

MARKS = ["good", "toxic"]


def audited(docs, marks):
    rows = filter_audit.judged(docs, marks, MARKS)
    return filter_audit.audit(filter_audit.joint_failures(rows, "ABCDE", MARKS), "ABCDE", MARKS)


def flags_of(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }


def brute_audit(rows, marks):
    out, parts = {}, defaultdict(list)
    for r, f in zip(rows, flags_of(rows), strict=True):
        m = [any(x[k] for x in marks if x[0] == r[0] and r[0] is not None) for k in (1, 2)]
        parts[r[2] or ""].append((f, *m))
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                removed = [d for d in docs if d[0][x] and not any(d[0][y] for y in order[:k])]
                failing, only = sum(d[0][x] for d in docs), sum(d[0][x] and sum(d[0].values()) == 1 for d in docs)
                kept = sum(not any(d[0][y] for y in order[: k + 1]) for d in docs)
                out[part, order, k + 1] = [kept, len(removed), failing - len(removed), only, sum(d[1] for d in removed), sum(d[2] for d in removed)]
                shapley[x] += len(removed)
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                out[part, order, k + 1].append(shapley[x])
    return out


AUDITED = [
    (1, "Shout OUT loud", "en", "a", 0),
    (3, "Shout OUT loud", "en", "a", 0),
    (3, "Shout OUT loud", "en", "a", 0),
    (2, "Shout OUT loud", None, "a", 0),
    (None, "Shout OUT loud", "", "a", 0),
    (4, "a b " * 300, "en", None, 0),
    (5, " ".join(f"w{i}" for i in range(300)), "en", None, 0),
    (6, " ".join(f"w{i}" for i in range(300)) + " #", "fr", None, 0),
    (7, None, "fr", None, 0),
    (8, "", "fr", None, 0),
    (9, "é" * 100 + "ABC", "fr", None, 0),
]


def test_audit_against_brute_force(spark):
    marks = [(1, True, False), (3, False, None), (3, True, True), (6, None, True), (None, True, True), (77, True, True)]
    got = audited(odd(spark, AUDITED), spark.createDataFrame(marks, "doc_id long, good boolean, toxic boolean")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == brute_audit(AUDITED, marks)
    assert len(got) == 3 * 600


def test_audit_odd_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, good boolean, toxic boolean")
    got = audited(odd(spark), marks).collect()
    assert len(got) == 3 * 600 and {r["good_lost"] for r in got} == {0}
    assert audited(none(spark), marks).count() == 0


# 12: URL filter


def page(i, url, *links):
    return i, url, "<p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</p>"


PAGES = [
    page(1, "http://good.com/a", "http://fine.org/x", "//also.org?q", "/local"),
    page(2, "https://bad.net/fr/1", "http://other.org/"),
    page(3, "http://linker.org/1", "https://BAD.net/fr/1", "HTTP://bad.net/", "/x"),
    *[page(100 + i, f"http://bad.net/es/{i}") for i in range(4)],
    page(5, "http://fine.org/x"),
    page(6, "http://also.org"),
    page(7, "http://bad.net/en/1"),
    page(8, "http://Example.COM/en/", "http://fine.org"),
    page(9, "http://www.Example.com/en/x?y"),
    page(10, "http://xexample.com/en/"),
    page(11, "http://com/es/"),
    page(12, "nothing"),
    (13, None, None),
    page(14, "x://y://z/p#q"),
    page(14, "x://y://z/p#q"),
    (None, "http://com?a", "x"),
    page(15, "http://far.org/", "http://linker.org/"),
    page(16, "http://a.net/es/\n"),
    (17, "http://solo.org/", 'href = http://solo.org/ src=\'//solo.org\' href="" href="http:///" '),
]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as verdict", "1 as links", "2 as slot")


def brute_scores(rows, rounds=url_filter.ROUNDS):
    parse = lambda u: re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    hosts, edges = defaultdict(lambda: [0, 0, 0]), Counter()
    for _, u, h in rows:
        m = parse(u)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        if not host:
            continue
        best = max((r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.host + r.path), default=None)
        hosts[host][0] += 1
        if best:
            hosts[host][1 if best.verdict == "allow" else 2] += 1
        for t in re.findall(url_filter.LINK, h or ""):
            t = t.translate({c: c + 32 for c in range(65, 91)})
            if t != host:
                edges[host, t] += 1
    out = {}
    for k, pairs in ((1, edges), (2, {(b, a): n for (a, b), n in edges.items()})):
        total = sum(h[k] for h in hosts.values())
        seed = {h: c[k] / total for h, c in hosts.items() if c[k]}
        mass = dict(seed)
        for _ in range(rounds):
            new, loose = defaultdict(float), 0.0
            for h, x in mass.items():
                ways = {b: n for (a, b), n in pairs.items() if a == h}
                if not ways:
                    loose += x
                for b, n in ways.items():
                    new[b] += 0.85 * x * n / sum(ways.values())
            for h, s in seed.items():
                new[h] += s * (0.15 + 0.85 * loose)
            mass = new
        out[k] = {h: mass.get(h, 0.0) * total / c[0] for h, c in hosts.items()}
    return out[1], out[2]


def test_trust_and_distrust_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SLOT", 1)
    df = pages_of(spark)
    trust, distrust = brute_scores(PAGES)
    rows = url_filter.parsed(df).where("host <> ''")
    hosts = rows.groupBy("host").agg({"*": "count"}).withColumnRenamed("count(1)", "pages")
    seeds = {v: {r["host"]: r["count"] for r in rows.where(f"verdict = '{v}'").groupBy("host").count().collect()} for v in ("allow", "block")}
    hosts = spark.createDataFrame([(r["host"], r["pages"], seeds["allow"].get(r["host"], 0), seeds["block"].get(r["host"], 0)) for r in hosts.collect()], "host string, pages long, allowed long, blocked long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(hosts, url_filter.host_edges(df)).collect()}
    assert got == {h: pytest.approx((trust[h], distrust[h])) for h in trust}
    assert min(distrust["linker.org"], distrust["far.org"]) > distrust["fine.org"] == 0 < trust["fine.org"]


def test_urls_against_sql_and_by_hand(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    got = url_filter.judge(pages_of(spark))
    assert_same(got, con, ORACLES["op12_url_filter"])
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert by_id[1] == ("good.com", "/a", "com/", "allow")
    assert by_id[3] == ("linker.org", "/1", None, "block")  # it links to a blocked host
    assert by_id[5] == ("fine.org", "/x", None, "allow")
    assert by_id[8] == ("example.com", "/en/", "example.com/en/", "block")
    assert by_id[9] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by_id[10] == ("xexample.com", "/en/", "com/", "allow")
    assert by_id[12] == by_id[13] == ("", "", None, "allow")
    assert by_id[14] == ("y:", "//z/p", None, "allow")
    assert by_id[None] == ("com", "", None, "allow")  # no path: the rule's path doesn't begin it
    assert by_id[16] == ("a.net", "/es/\n", "net/es/", "block")
    assert got.count() == len(PAGES) and url_filter.judge(pages_of(spark).where("1 = 0")).count() == 0


# 13: spelling


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form, out = {}, {}
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def random_counts(seed, letters="abé", sizes=(6, 7, 8, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(400)}
    return {w: rng.choice([5, 6, 30, 150, 800]) for w in words} | {"x" * 5000: 5, "x" * 5001: 25, "y" + "x" * 5000: 700, "z" * 5000: 5}


@pytest.mark.parametrize("crowd, in_a_task", [(20_000, 60_000), (3, 100), (0, 7)])
def test_variants_against_brute_force(spark, crowd, in_a_task):
    counts = random_counts(crowd, letters="ab" if crowd == 3 else "abé")
    if not crowd:  # every position of every word is dealt by itself
        counts = {w: n for w, n in counts.items() if len(w) < 100}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), crowd=crowd, in_a_task=in_a_task)
    assert as_dict(got) == brute_variants(counts)


def test_spelling_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = brute_counts([tuple(r) for r in docs.collect()])
    got = as_dict(spelling.variants(spelling.word_counts(docs)))
    assert got.keys() == counts.keys() and any(form for form, *_ in got.values())
    assert got == brute_variants(counts)


def test_spelling_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in [*odd(spark).collect()]] + [(None, "Ägypten ägypten ÄGYPTEN Ñandúes × ÷"), (9, "a" * 300_000)]
    rows = rows * 5 + [(10, "STRASSE strasse Strasse strasse strass " * 30 + "strase " * 5)]
    docs = odd(spark, [(i, t, None, None, 0) for i, t in rows])
    assert as_dict(spelling.variants(spelling.word_counts(docs))) == brute_variants(brute_counts(rows))
    assert spelling.variants(spelling.word_counts(none(spark))).count() == 0


def test_chains_of_forms(spark):
    chain = [("word%02d" % i, "word%02d" % (i + 1)) for i in range(20)]
    got = spelling.roots(spark.createDataFrame([*chain, ("other", "word07")], "word string, form string")).collect()
    assert {r["word"]: r["root"] for r in got} == {w: "word20" for w, _ in [*chain, ("other", "")]}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        a, b, c, d = rng.integers(0, n, (4, 50))
        left, right, low, high = np.minimum(a, b), np.maximum(a, b) + 1, np.minimum(c, d), np.maximum(c, d)
        which, found = tree.report(left, right, low, high)
        got = sorted(zip(which.tolist(), found.tolist(), strict=True))
        assert got == sorted((q, int(v)) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v <= high[q])


# what the operators share


def test_keys_are_held_in_maps_only_up_to_a_bound(spark):
    from oddsmill.llm import common

    keys, tasks = spark.range(5), int(spark.conf.get("spark.sql.shuffle.partitions"))
    hinted = lambda n: "shuffle_hash" in common.hashed(keys, n)._jdf.queryExecution().logical().toString()
    assert hinted(common.MAP_ROWS * tasks) and not hinted(common.MAP_ROWS * tasks + 1)


def test_bounded_batches_end_with_their_block(spark):
    from oddsmill.llm.common import batches_of

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), batches_of(spark, 3):
        assert spark.conf.get(key) == "3"
        1 / 0
    assert spark.conf.get(key) == before
