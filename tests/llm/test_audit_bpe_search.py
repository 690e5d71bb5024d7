"""Filter audit, byte-pair encoding and lexical search against brute force, the library and SQL."""
import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kpiforge.llm import bpe_pairs, filter_audit, lexical_search, registry
from test_llm import DOC_SCHEMA, EDGE_TEXTS, SF, docs_of, run

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["op11_filter_audit", "op12_bpe", "op13_lexical_search"]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """Null and repeated ids and rows, copies, ties, parts with a null name, clashing extra columns."""
    d = tmp_path_factory.mktemp("edge3")
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), 1, "w", 0.5, True) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "tie tie", "en", None, None, 1, "w", 0.5, True)] * 2 + [(4, "tie tie", "en", "s", 7, 1, "w", 0.5, True)] * 3
    rows += [(4, "other text", "de", "s", 7, 1, "w", 0.5, True), (100, "tie tie", "de", "s", 7, 1, "w", 0.5, True), (99, "tie tie", "", "s", 7, 1, "w", 0.5, True)]
    rows += [(200 + i, "Word " * (90 + i) + "#" * (i % 2), "de", "s", 1, 1, "w", 0.5, True) for i in range(20)]
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (None, 1, 1), (99, None, None), (205, 1, 0), (206, 0, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(0, "TIE word"), (1, None), (2, "..."), (3, "tie tie tie"), (4, "word x日本語 other text b"), (4, "word x日本語 other text b"), (5, "absent")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(params=["small", "edge"])
def folder(request, edge):
    return SF if request.param == "small" else edge


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_lexical_search"])
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        glob = f"{folder}/{t}.parquet" + ("" if folder == SF else "/*.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{glob}')")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = registry.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(cols)
    norm = lambda rows: sorted(rows, key=repr)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(cur.fetchall())


def brute_audit(rows, labels):
    firsts = {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t] = min(firsts.get(t, d), d)
    good, toxic = ({d for d, *m in labels if m[k] == 1 and d is not None} for k in (0, 1))
    parts = {}
    for d, t, lang in rows:
        w = WORD.findall(t)
        fails = "".join(f for f, hit in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), d is not None and d > firsts[t])) if hit)
        parts.setdefault(lang or "", []).append((fails, d in good, d in toxic))
    out, shares = {}, {}
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [x for x in docs if f in x[0] and not set(order[:k]) & set(x[0])]
                out[part, order, k + 1] = [
                    sum(not set(order[:k + 1]) & set(x[0]) for x in docs), len(here), sum(f in x[0] for x in docs) - len(here),
                    sum(x[0] == f for x in docs), sum(x[1] for x in here), sum(x[2] for x in here)]
                shares[part, f] = shares.get((part, f), 0) + len(here)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, edge, monkeypatch):
    """In one range of ids and in many."""
    rows = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{edge}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{edge}/labels.parquet").collect()]
    want = brute_audit(rows, labels)
    for size in (40_000, 3):
        monkeypatch.setattr(filter_audit, "ROWS_PER_TASK", size)
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
               for r in run(spark, "op11_filter_audit", edge)}
        assert got == want


def test_galloping_merges():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lists = [np.unique(rng.integers(0, rng.choice([50, 100_000]), rng.integers(0, 400))) for _ in range(5)]
        assert filter_audit.union(lists).tolist() == sorted(set().union(*map(set, lists)))
        assert filter_audit.minus(lists[0], lists[1]).tolist() == sorted(set(lists[0]) - set(lists[1]))
        at = int(rng.integers(0, len(lists[0]) + 1))
        bound = int(rng.integers(0, 120))
        assert filter_audit.gallop(lists[0], at, bound) == max(at, int(np.searchsorted(lists[0], bound)))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_bpe_equals_the_library(spark, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = docs_of(spark, folder)
    want = []
    for d, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op12_bpe", folder)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bpe_of_odd_white_space_and_specials():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    signs = list("a b\n\t'sx1. é 日\x1c\x0b<　") + ["<|endoftext|>", "  ", "'ll"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(4000)] + ["a" * 5001, "ab" * 3000 + "a", ""]
    for limit in (bpe_pairs.TABLE_LIMIT, 10):  # also with a table that is begun anew
        bpe_pairs._KNOWN.clear()
        bpe_pairs.TABLE_LIMIT, before = limit, bpe_pairs.TABLE_LIMIT
        try:
            for lo in range(0, len(texts), 1500):
                ids, counts = bpe_pairs.encode_batch(texts[lo:lo + 1500], path)
                ends = np.cumsum(counts)
                got = [ids[e - c:e].tolist() for e, c in zip(ends, counts)]
                assert got == [e.ids for e in tok.encode_batch(texts[lo:lo + 1500], add_special_tokens=False)]
        finally:
            bpe_pairs.TABLE_LIMIT = before


def test_bpe_decodes_any_ids(spark):
    """Also ids in an order no text gives: broken UTF-8 as the library shows it."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(0, 50257, rng.integers(0, 30))]) for i in range(200)] + [(900, None), (901, [50256, 0])]
    got = {r.doc_id: r.text for r in bpe_pairs.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {i: tok.decode(ids or [], skip_special_tokens=False) for i, ids in rows}


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe_pairs.MergeTable(public_tokenizers.path("word_bpe_49k.json"))


def brute_search(docs, items, top=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, cut(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            m = 100 - 75 + (75 * len(w) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in cut(text) if t in w)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(map(repr, out))


def test_search_equals_brute_force(spark, edge, monkeypatch):
    """One shard and many, lists all short and all long, one block of items and several."""
    docs = docs_of(spark, edge)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{edge}/benchmark.parquet").collect()]
    want = brute_search(docs, items)
    for chars, share, block in ((8_000_000, 1 / 16, 200_000), (200, 1 / 16, 4), (8_000_000, 2.0, 200_000), (8_000_000, 0.0, 200_000)):
        monkeypatch.setattr(lexical_search, "SHARD_CHARS", chars)
        monkeypatch.setattr(lexical_search, "SHORT_SHARE", share)
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
        assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in run(spark, "op13_lexical_search", edge)) == want


def test_search_shard_skips_nothing_that_counts():
    """Random lists: the ten best of every shard, ties included, whatever is skipped."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        lists = []
        for _ in range(int(rng.integers(1, 8))):
            d = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.1, 0.6]))
            if len(d):
                lists.append((d, rng.integers(1, rng.choice([3, 1000]), len(d))))
        best = lexical_search.Best(10)
        lexical_search.search_shard(lists, list(range(n)), best) if lists else None
        total = np.zeros(n, np.int64)
        for d, s in lists:
            total[d] += s
        order = sorted((i for i in range(n) if total[i]), key=lambda i: (-total[i], i))[:10]
        assert best.rows == [(int(total[i]), i) for i in order]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOC_SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in NAMES:
        assert run(spark, name, str(tmp_path)) == [], name


def test_pipeline_stages_do_what_the_operators_say(spark, edge):
    """Rows and texts of every stage on its own input: rejected rows go, one per group stays, secrets are masked,
    and the pieces put together are the documents' ids."""
    import corpus_pipeline
    from kpiforge.llm import quality_rules, secrets_scan, simhash, toxicity
    for folder in (SF, edge):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        labels = spark.read.parquet(f"{folder}/labels.parquet")
        stages = dict(corpus_pipeline.STAGES)
        ids = lambda df: sorted(repr(r.doc_id) for r in df.select("doc_id").collect())
        kept = stages["quality_rules"](spark, docs, folder)
        assert ids(kept) == ids(quality_rules.quality_report(docs, labels).where("kept"))
        clean = stages["toxicity"](spark, docs, folder)
        assert ids(clean) == ids(toxicity.score_documents(docs, labels).where("predicted = 0"))
        one = stages["simhash_near_duplicates"](spark, docs, folder)
        if folder == SF:  # elsewhere ids repeat, so a group's smallest id does not name it
            groups = simhash.simhash_components(docs)
            assert ids(one) == ids(groups.select(groups["component_id"].alias("doc_id")).distinct())
        words = secrets_scan.dictionary(public_tokenizers.path("byte_bpe_50k.json"))
        want = sorted(repr((d, None if t is None else secrets_scan.redact_text(t, secrets_scan.find_spans(t, words, secrets_scan.MIN_LOG10), "[SECRET]")))
                      for d, t in ((r.doc_id, r.text) for r in docs.collect()))
        assert sorted(repr((r.doc_id, r.text)) for r in stages["secret_scan"](spark, docs, folder).collect()) == want
        pieces = stages["packing"](spark, docs, folder).collect()
        tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        sizes = sorted(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs_of(spark, folder))
        assert sum(p.length for p in pieces) == sum(sizes)
        assert sorted(p.doc_tokens for p in pieces if p.start == 0) == sizes
