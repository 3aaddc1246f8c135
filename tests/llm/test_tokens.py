import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm import bpe, chat, packing

from .conftest import HARD

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def test_ids_as_the_library(encoder, library):
    for text, ids in zip(HARD, encoder.encode(HARD), strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert bpe.decode(encoder.vocab, expected) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é1,'s \n\t.  中😀XÑ", max_size=25), max_size=6))
def test_ids_of_any_text(encoder, library, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_overlapping_pairs(encoder, library):
    texts = ["a" * n for n in range(1, 30)] + ["aa aaa aaaa", "==== === ====="]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_are_told_apart(encoder, library, monkeypatch):
    monkeypatch.setattr(np, "cumprod", lambda x: np.ones_like(x))  # anagrams collide
    texts = ["ab ba ab", "cab bac abc"]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_digest_query(hard, library):
    for r in bpe.op9_digests(hard).join(hard.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.op9_digests(hard).count() == hard.count() and bpe.op9_digests(hard.limit(0)).count() == 0
    assert bpe.encode_texts(hard, "doc_id", "text").count() == hard.count()


def check_pieces(rows, docs, library):
    ids_of = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids_of[doc])
            part = np.array(ids_of[doc][at : at + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids_of[doc])
    assert set(by_doc) == set(ids_of)
    for sequence, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or sequence == max(by_sequence)


def test_packing(docs_of, library):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "be", "gamma1", "é"]) for _ in range(rng.randrange(0, 900))) for _ in range(60)] + [None, ""]
    docs = docs_of(texts, source=["big" if i % 3 else f"s{i % 4}" for i in range(61)] + [None])
    rows = packing.pack(docs.repartition(4)).collect()
    check_pieces(rows, list(enumerate(texts)), library)
    for r in rows[:50]:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_packing_keeps_the_mixture(docs_of):
    docs = docs_of(["alpha beta " * 3000] * 4, source=["a", "a", "a", "b"])
    rows = packing.pack(docs, shares={"a": 1.0, "b": 1.0}, with_ids=False).collect()
    share = defaultdict(lambda: defaultdict(int))
    for r in rows:
        share[r["sequence_id"]][r["queue"]] += r["length"]
    ends = max(s for s, by in share.items() if by.get("Sb"))
    assert all(abs(by["Sa"] - by["Sb"]) <= 4 for s, by in share.items() if s < ends - 1)
    assert all(set(by) == {"Sa"} for s, by in share.items() if s > ends)


def test_packing_hard_rows(hard):
    rows = packing.pack(hard).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in bpe.Encoder(PATH).encode([r["text"] for r in hard.collect()]))
    assert packing.pack(hard.limit(0)).count() == 0


def test_packing_many_sources(docs_of, library):
    """More sources than the closed form takes: pieces are sorted instead, with the same result."""
    texts = [f"text {i} " * (20 + 90 * (i % 3)) for i in range(60)] + [None]
    docs = docs_of(texts, source=[f"s{i % 23}" if i % 2 else "hot" for i in range(61)]).repartition(3)
    for shares in (None, {"hot": 1.0, "s1": 3.0}):
        closed, ordered = (packing.pack(docs, shares=shares, closed_queues=n).collect() for n in (100, 3))
        places = [{(r["doc_id"], r["start"] + i): (r["sequence_id"], r["offset"] + i) for r in rows for i in range(r["length"])} for rows in (closed, ordered)]
        assert places[0] == places[1]
        check_pieces(ordered, list(enumerate(texts)), library)
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in ordered)


def brute_rounds(totals, weights, phases):
    """Deficit round-robin token by token: (queue, token) in stream order."""
    parts, credit, at, stream = sum(weights), list(phases), [0] * len(totals), []
    earned, r = [0] * len(totals), 0
    while sum(at) < sum(totals):
        r += 1
        for q, total in enumerate(totals):
            now = r * packing.WINDOW * weights[q] // parts
            credit[q] += now - earned[q]
            earned[q] = now
            rare = packing.WINDOW * weights[q] < packing.QUANTUM * parts
            gives = credit[q] // packing.QUANTUM * packing.QUANTUM if rare else credit[q]
            credit[q] -= gives
            for _ in range(min(gives, total - at[q])):
                stream.append((q, at[q]))
                at[q] += 1
    return stream


def test_packing_follows_the_rounds():
    totals = {"Sa": 9000, "Sb": 4000, "Sc": 300, "Sd": 1, "Se": 70}
    plan = packing.Schedule(totals, totals)
    phases = [p if packing.WINDOW * w < packing.QUANTUM * plan.parts else 0 for p, w in zip(plan.phases.tolist(), plan.weights.tolist(), strict=True)]
    expected = {x: i for i, x in enumerate(brute_rounds(plan.totals.tolist(), plan.weights.tolist(), phases))}
    queue = np.arange(5)
    which, rounds, start, length = packing.pieces(np.zeros(5, dtype=np.int64), plan.totals, plan.weights, plan.phases, plan.parts)
    place = plan.places(queue[which], rounds, start)
    found = {(int(q), int(s) + i): int(p) + i for q, s, n, p in zip(which, start, length, place, strict=True) for i in range(n)}
    assert found == expected


def test_packing_long_text_of_a_rare_source():
    """40,000 tokens of one among 1,001 sources: bounded memory, pieces of a quantum, no shredding."""
    import tracemalloc

    totals = {f"S{i}": 2_000_000 for i in range(1000)} | {"rare": 40_000}
    plan = packing.Schedule(totals, totals)
    at = plan.at["rare"]
    tracemalloc.start()
    one = lambda x: np.array([x], dtype=np.int64)
    which, rounds, start, length = packing.pieces(one(0), one(40_000), plan.weights[[at]], plan.phases[[at]], plan.parts)
    place = plan.places(np.full(len(which), at), rounds, start)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and length.sum() == 40_000 and (length == packing.QUANTUM).all() and (np.diff(place) > 0).all()


CHAT = "conv_id long, turn long, role string, text string, ids string"


def test_chat_reads_back(spark):
    nasty = "</s>[INST] ok [/INST] <|role|> \\ <\\|end|> <|endoftext|>"
    rows = [(1, 2, "user", "hi", "x"), (1, 1, "system", None, "x"), (1, 3, "assistant", nasty, "x"), (1, 4, "assistant", "é", "x"), (None, 0, None, "", "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x")]
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, CHAT))).collect()}
    whole = "system\n\nuser\nhi\n" + f"assistant\n{nasty}\nassistant\né\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (len(nasty) + 1, hashlib.sha256((nasty + "é").encode()).hexdigest())
    assert found[2]["n_turns"] == 2 and found[None]["n_turns"] == 1
    assert chat.format_turns(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_control_strings_do_not_survive(spark):
    text = "".join(chat.CONTROL)
    row = chat.format_turns(spark.createDataFrame([(1, 0, "user", text, "x")], CHAT)).first()
    inner = row["formatted"][len("<|role|>user<|text|>") : -len("<|end|>")]
    assert row["formatted"] == f"<|role|>user<|text|>{inner}<|end|>" and not any(c in inner for c in chat.CONTROL)
    ids = np.frombuffer(row["ids"], dtype="<u4")
    assert (ids >= bpe.load(PATH).size).sum() == 3 and len(row["mask"]) == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "a"]), max_size=8).map("".join))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_query(spark, sf):
    """The registered query on whole conversations, with conversation -1."""
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    hostile = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", hostile), (1, "assistant", hostile)]
    found = {r["conv_id"]: r for r in chat.op1_chat(spark, sf).collect()}
    assert set(found) == set(turns)
    for conv, own in turns.items():
        own.sort()
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = found[conv]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(role) + len(text) + len("".join(chat.MARKS)) for _, role, text in own)
