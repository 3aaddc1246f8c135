import hashlib
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from emberline.llm import exact_dedup, simhash, url_filter
from emberline.llm.common import join_spread
from emberline.llm.components import connected_components


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_matches_brute_force(hard):
    rows = hard.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r["text"])].append(r["doc_id"])
    expected = []
    for r in rows:
        ids = groups[lowered(r["text"])]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        expected.append((r["doc_id"], keep, len(ids), r["doc_id"] == keep, hashlib.sha256(lowered(r["text"]).encode()).hexdigest()))
    for bits in (1 << 27, 64):  # a crowded filter changes what is shuffled, not the result
        found = [tuple(r) for r in exact_dedup.annotate_duplicates(hard, bits).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_exact_drop_keeps_columns_and_one_of_each(hard):
    kept = exact_dedup.drop_duplicates(hard)
    assert kept.columns == hard.columns
    rows = kept.collect()
    texts = [lowered(r["text"]) for r in rows]
    assert len(texts) == len(set(texts)) == len({lowered(r["text"]) for r in hard.collect()})
    assert exact_dedup.drop_duplicates(hard.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_unique_rows_do_not_shuffle(docs_of):
    """Pass one shuffles slots alone, one a document and none twice a task; pass two sends no row that is alone through a shuffle."""
    digests = docs_of([f"text {i}" for i in range(50)] + ["text 1"]).select("doc_id", F.xxhash64("text").alias("h"))
    bits = exact_dedup.filter_bits(51)
    chunks = exact_dedup.repeat_filter(digests, "h", bits)
    assert "Generate" not in plan_of(chunks) and plan_of(chunks).count("Exchange hashpartitioning(slot") == 1
    assert "doc_id" not in plan_of(chunks).split("Exchange hashpartitioning(slot")[0]
    flagged = exact_dedup.flag_possible_repeats(digests, F.col("h"), exact_dedup.checkpointed(chunks), "maybe", bits)
    assert "Exchange hashpartitioning" not in plan_of(flagged.filter("not maybe")) and "BroadcastExchange" in plan_of(flagged)
    assert 2 <= flagged.filter("maybe").count() <= 6


def test_exact_beyond_the_filter(hard, monkeypatch):
    """More rows than bits: no filter is built, the result is the same."""
    whole = sorted(map(tuple, exact_dedup.annotate_duplicates(hard).collect()), key=str)
    kept = sorted(r["text"] or "" for r in exact_dedup.drop_duplicates(hard).collect())
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 8)
    monkeypatch.setattr(exact_dedup, "repeat_filter", None)
    assert sorted(map(tuple, exact_dedup.annotate_duplicates(hard).collect()), key=str) == whole
    assert sorted(r["text"] or "" for r in exact_dedup.drop_duplicates(hard).collect()) == kept


def test_columns_of_any_name_and_type(docs_of):
    """Helper names, dots, backquotes and a map column stay as they are."""
    docs = docs_of(["a b", "A b", "c", None, "a b"], ids=[1, 2, 3, 4, 2]).withColumns({n: F.lit(n) for n in ("__chunk0", "chunk0", "__gone", "gone", "__host", "salt", "maybe")})
    docs = docs.withColumn("a.b", F.col("doc_id") * 2).withColumn("q`r", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), "text")).withColumn("url", F.concat(F.lit("http://x.org/"), "text"))
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert all(r["a.b"] == 2 * r["doc_id"] and r["m"] == {"k": r["text"]} for r in kept.collect())
    near = simhash.keep_representatives(docs)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {1, 3, 4}
    judged = url_filter.match_rules(docs)
    assert judged.columns == [*docs.columns, "host", "path", "rule", "verdict"] and {r["a.b"] for r in judged.collect()} == {2, 4, 6, 8}


def test_filter_follows_the_rows():
    assert [exact_dedup.filter_bits(n) for n in (0, 1, 5000, 10**6, 10**12)] == [1 << 15, 1 << 15, 1 << 18, 1 << 25, exact_dedup.FILTER_BITS]


def test_one_group_meets_its_value_in_many_tasks(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("salt"))
    values = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = join_spread(rows, values, "k", "id", salts=16)
    assert found.columns == ["k", "id", "salt", "n"] and found.count() == 4000
    assert found.filter("k = 7").select("n").distinct().collect()[0][0] == 1335  # every third id, and 7 itself


def reference(text):
    words = regex.findall("[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values):
    """Component minimum of each value by brute force over all pairs."""
    least = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 4:
                    least[i] = min(least[i], least[j])
    return least


def test_fingerprints(hard):
    rows = hard.select("doc_id", "text").collect()
    found = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(hard).collect()}
    for r in rows:
        if len(r["text"] or "") < 1000:
            assert found[r["doc_id"]] & (1 << 64) - 1 == reference(r["text"])


@pytest.mark.parametrize("bands", [1, 3])
def test_links_against_all_pairs(spark, bands):
    rng = np.random.default_rng(bands)
    values = []
    for _ in range(12):  # clusters whose members are 0 to 6 bits from a centre
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(8):
            x = centre
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                x ^= 1 << int(b)
            values.append(x)
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bands=bands))
    component = {r["node"]: r["component"] for r in found.collect()}
    least = linked(values)
    for i, v in enumerate(signed):
        for j, w in enumerate(signed):
            assert (component.get(v, v) == component.get(w, w)) == (least[i] == least[j])


def test_balls():
    assert len(simhash.ball((1 << 64) - 1, 2)) == 2081
    assert sum(len(simhash.ball(m, r)) for m, r in simhash.views(3)) == 131


def test_groups_and_representatives(docs_of, hard):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base.replace("w150", "other"), base.upper(), "something else entirely here", None, ""]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs_of(texts)).collect()}
    assert found[2] == 0 and found[3] == 3 and found[5] == found[4] == 4
    kept = simhash.keep_representatives(hard)
    assert kept.columns == hard.columns and 0 < kept.count() < hard.count()
    assert simhash.near_duplicate_groups(hard).count() == hard.count()
    assert simhash.near_duplicate_groups(hard.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 60)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(60)} == {100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
