"""Training-data operators: mixing, token files, de-duplication, language, quality, secrets, search, archives, packing.

Nothing outside this subpackage imports it.
"""
