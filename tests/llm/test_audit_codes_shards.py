import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import divergence, sharding, vector_codes


def with_sql(sf, name, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same_as_sql(df, sf, name, sql):
    names, rows = with_sql(sf, name, sql)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(rows, key=str)


# --- source divergence -------------------------------------------------------------------------------------------------


def audit_by_hand(rows):
    """rows: (text, lang, source)."""
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    in_docs, counts = Counter(), Counter()
    for lang, source, terms in words:
        in_docs.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {w[0] for w in words}:
        kept = sorted(t for (at, t), n in in_docs.items() if at == lang and n >= 10)
        groups = sorted({w[1] for w in words if w[0] == lang})
        shares = lambda n: [1 + 1_000_000_000 * (x + 2) // (sum(n) + 2 * len(kept)) for x in n]
        n = {g: [counts[lang, g, t] for t in kept] for g in groups}
        p = {g: shares(n[g]) for g in groups}
        q = shares([sum(n[g][i] for g in groups) for i in range(len(kept))])
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for g in groups:
            pair = [(-sum(map(f, p[g], p[h])), h.encode()) for h in groups if h != g]
            term = [(-f(p[g][i], q[i]), t.encode()) for i, t in enumerate(kept) if n[g][i] and p[g][i] > q[i]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out += [(lang, g, part, item.decode(), -value, k) for k, (value, item) in enumerate(items, start=1)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in divergence.audit(df).collect())


def test_divergence_on_hard_rows(spark, monkeypatch):
    """Nulls, ties, capitals beyond ASCII, a source without terms, a lang without kept terms, one source alone, a very long text, clashing names."""
    texts = [("Alpha beta, BETA gamma", "en", f"s{i % 3}") for i in range(14)] + [("ÉCOLE école alpha zeta", "en", "s9")] * 11
    texts += [(None, "en", "empty"), ("", None, None), ("rare", "xx", "a"), ("rarer", "xx", "b"), ("x1x2x" + " alpha" * 30_000, "en", "s0"), ("only words", "zz", "alone")]
    texts += [("w%d same" % (i % 4), None, None if i % 2 else "n") for i in range(44)]
    df = spark.createDataFrame(texts, "text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("t"), "doc": F.lit("d"), "item": F.lit(2)})
    expected = audit_by_hand(texts)
    assert audited(df.repartition(5)) == expected and {r[2] for r in expected} == {"pair", "term"}
    monkeypatch.setattr(divergence, "HELD_ROWS", 3)
    assert audited(df.repartition(2)) == expected
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_matches_sql(spark, sf):
    same_as_sql(divergence.op11_divergence(spark, sf), sf, "documents", divergence.ORACLE)


def test_divergence_shares_fit_when_counts_are_huge(spark):
    n, total, v = 4 * 10**15, 9 * 10**15, 7
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * v) and row["none"] is None


# --- vector codes ------------------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, embedding, label), Python integers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    named = sorted({i for i, _, _ in kept if i is not None})
    if not named:
        return []
    seeds = [min(v for j, v, _ in kept if j == i) for i in named]
    length = len(seeds[0])
    if length % parts:
        return []
    w = length // parts
    kept = [r for r in kept if len(r[1]) == length]
    seeds = [s for s in seeds[:entries] if len(s) == length]
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(s)[p] for s in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            to = defaultdict(list)
            for _, v, _ in kept:
                to[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(col) // len(to[e]) for col in zip(*to[e], strict=True)) if e in to else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(x, books[p]) for p, x in enumerate(cut(v))] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return [(i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], sha) for (i, _, label), f, error in zip(kept, found, errors, strict=True)]


def coded(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"ints": F.lit(1), "codes": F.lit("c"), "error": F.lit(0), "kind": F.lit("k")})
    return sorted((tuple(r) for r in vector_codes.compress(df.repartition(3), **options).collect()), key=str)


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e4])
def test_codes_on_hard_rows(spark, scale):
    """Bad rows, ties, repeats, null ids and labels; components that need exact integers beyond 2^53."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(1) * scale], int(i) % 3 or None) for i in rng.permutation(120)]
    rows += rows[:9] + [(7, [scale] * 8, 1), (None, [0.0] * 8, None), (None, [0.5] * 8, 2)] + [(500 + i, [0.25 * scale] * 8, 1) for i in range(200)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [1.0, None] * 4, 1), (-4, [float("nan")] * 8, 1), (-5, [float("inf")] * 8, 1), (-6, [-float("inf")] * 8, 1), (-7, [2.0**52] * 8, 1)]
    rows += [(900, [1.0] * 12, 1), (901, [1.0] * 7, 1)]
    for entries in (16, 256):
        assert coded(spark, rows, entries=entries) == sorted(codes_by_hand(rows, entries=entries), key=str)


def test_codes_of_few_rows_and_odd_lengths(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(3, [0.0, 1.0, -1.0, 2.0], None)], [(2, [1.0] * 4, 1), (1, [2.0] * 8, 1)]):
        assert coded(spark, rows) == sorted(codes_by_hand(rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(0, 300), st.sampled_from([1, 3, 40, 2**27, 2**45]))
def test_search_equals_full_scan(seed, entries, rows, spread):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread, (entries, 3), endpoint=True)
    parts = rng.integers(-spread, spread, (rows, 3), endpoint=True)
    codes, errors = vector_codes.Codebook(book).assign(parts, rng.integers(0, entries, rows))
    every = ((parts.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(axis=2)
    assert codes.tolist() == [row.tolist().index(min(row)) for row in every] and errors.tolist() == [min(row) for row in every]


def test_codes_match_sql(spark, sf):
    same_as_sql(vector_codes.op12_vector_codes(spark, sf), sf, "embeddings", vector_codes.ORACLE)


# --- sharding ----------------------------------------------------------------------------------------------------------


def shard_by_hand(key, tree):
    node, children = "", tree.children()
    for _ in range(3):
        draw = lambda path: (-math.log((int(hashlib.md5(f"{path}/{key}".encode()).hexdigest()[:15], 16) + 1) / 2**60) / children[node][path], path)  # noqa: B023, E731
        node = min(children[node], key=draw)
    return int(node.rsplit("/", 1)[1])


def placed(df, tree, more):
    return [tuple(r) for r in sharding.place(df, tree, more).collect()]


def test_shards_by_hand(hard, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 2)
    df = hard.withColumns({"shard": F.lit("x"), "slot": F.lit(0), "bucket": F.lit(1), "copies": F.lit(2), "size": F.lit("s")})
    df = df.union(df.filter("doc_id = 1")).union(df.filter("doc_id = 1")).union(df.filter("doc_id = 1")).union(df.filter("doc_id = 1"))
    tree = sharding.TREE
    expected = []
    for r in df.collect():
        text, key = (r["text"] or "").encode(), "" if r["doc_id"] is None else str(r["doc_id"])
        expected.append((r["doc_id"], len(text) + 1, zlib.crc32(text), shard_by_hand(key, tree), shard_by_hand(key, tree.grown())))
    found = placed(df, tree, tree.grown())
    assert sorted(((*r[:4], r[5]) for r in found), key=str) == sorted(expected, key=str)
    for shard in {r[3] for r in found}:
        assert sorted(r[4] for r in found if r[3] == shard) == list(range(sum(r[3] == shard for r in found)))
    assert placed(df.limit(0), tree, tree.grown()) == []


def test_slots_do_not_depend_on_buckets(docs_of, monkeypatch):
    df = docs_of([f"t{i % 7}" for i in range(300)], ids=[i // 3 for i in range(300)])
    whole = sorted(placed(df, sharding.TREE, sharding.TREE.grown()))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    assert sorted(placed(df.repartition(7), sharding.TREE, sharding.TREE.grown())) == whole


def test_movement_is_confined(docs_of):
    """One more shard takes rows only into itself; a heavier shard draws rows to its rack and region, and no others move."""
    df = docs_of([""] * 4000)
    tree = sharding.even_tree(2, 2, 2)
    for _ in range(3):  # again and again
        rows = placed(df, tree, tree.grown())
        new = max(s for *_, s, _ in tree.grown().weights)
        assert all(r[5] in (r[3], new) for r in rows)
        share = sum(r[5] == new for r in rows) / len(rows)
        assert abs(share - 1 / len(tree.grown().weights)) < 0.025
        tree = tree.grown()
    tree = sharding.even_tree(2, 2, 2)
    heavier = sharding.Tree(tuple((r, k, s, 3.0 if s == 3 else w) for r, k, s, w in tree.weights))
    rows = placed(df, tree, heavier)
    region, rack = lambda s: s // 4, lambda s: s // 2
    for _, _, _, before, _, after in rows:
        assert region(after) in (region(before), region(3))
        if region(before) == region(after):
            assert rack(after) in (rack(before), rack(3))
            assert rack(before) != rack(after) or after in (before, 3)
    counts = Counter(r[5] for r in rows)
    assert abs(counts[3] / len(rows) - 3 / 10) < 0.03 and abs(counts[7] / len(rows) - 1 / 10) < 0.03


def test_trees_are_checked():
    for weights in ((), (("a", "b", 0, 0.0),), (("a", "b", 0, -1.0),), (("a", "b", 0, 1.0), ("a", "c", 0, 1.0))):
        with pytest.raises(ValueError):
            sharding.Tree(weights)
    assert list(sharding.Tree((("a", "b", 0, 1.0), ("z", "b", 1, 0.0))).children()) == ["", "/a", "/a/b"]


def test_shards_match_sql(spark, sf):
    df = sharding.op13_sharding(spark, sf)
    assert {r["law"] for r in df.select("law").distinct().collect()} == {"key"}
    same_as_sql(df, sf, "documents", sharding.ORACLE)
