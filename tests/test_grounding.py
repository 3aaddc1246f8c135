"""Claims by role against a walk through each claim; abstention."""

import random

from emberline.operators import grounding

CLAIM = "incident string, rank int, field string, text string, status string, evidence_ids array<string>"
CANDIDATE = "incident string, rank int, event_ids array<string>, impact_event_ids array<string>, adverse_outcome_event_ids array<string>"


def by_hand(claims, candidates, links, known):
    out = {}
    strings = lambda v: [x[:500] for x in (v or []) if x and x.strip()][:12]
    for incident, rank, field, said, status, given in claims:
        ids = {e for i, e in known if i == incident}
        _, _, event, impact, adverse = next((c for c in candidates if c[:2] == (incident, rank)), (None, None, [], [], []))
        cause = {x for x in strings(event) if x in ids}
        roles = {"cause": cause, "impact": {x for v in (impact, adverse) for x in strings(v) if x in ids}, "mechanism": set()}
        own = [v for i, _, v in links if i == incident]
        for v in own:
            linked = {x for x in strings(v) if x in ids}
            if len(linked) >= 2 and cause & linked:
                roles["mechanism"] |= linked
        cited = strings(given)
        valid, unknown = [x for x in cited if x in roles[field]], [x for x in cited if x not in ids]
        wrong = [x for x in cited if x in ids and x not in roles[field]]
        status = (status or "unknown").lower()
        status = status if status in grounding.STATUSES else "unknown"
        said = (said or "").strip()[:700]
        linked = any(set(v or []) <= set(valid) and len(v or []) >= 2 for v in own)
        case = ("empty" if not said else "unknown" if unknown else "incompatible" if wrong or not valid else "cause" if field == "cause" and status == "observed"
                else "unlinked" if field == "mechanism" and not linked else "linked" if field == "mechanism" and status == "observed" else "impact" if field == "impact" and status == "observed" else "supported")
        final = "unknown" if case in ("empty", "unknown", "incompatible", "unlinked") else "hypothesis" if case == "cause" else "inferred" if case in ("linked", "impact") else status
        out[incident, rank, field] = (said, status, final, "rejected" if case in ("empty", "unknown", "incompatible", "unlinked") else "downgraded" if case in ("cause", "linked", "impact") else "supported",
                                      grounding.REASONS[case], valid, unknown, wrong)
    return out


def test_claims_by_role(spark):
    """Every reason; null and blank texts, ids and statuses, repeated ids, more ids than count, candidates without claims and the other way round."""
    rng = random.Random(8)
    some = lambda n: rng.choice([None, [], [f"e{rng.randrange(9)}" for _ in range(n)], [f"e{rng.randrange(9)}" for _ in range(n)], ["e1", " ", None, "e1"], [f"e{i % 3}" for i in range(14)]])
    known = [(i, f"e{k}") for i in "ab" for k in range(7)]
    candidates = [(i, r, some(3), some(2), some(2)) for i in "ab" for r in (1, 2, 3)]
    links = [(i, k, rng.choice([["e1", "e2"], ["e2", "e8"], ["e3"], ["e1", "e1"], some(3)])) for i in "ab" for k in range(4)]
    statuses = [None, "observed", "Observed", "inferred", "hypothesis", "odd"]
    claims = [(i, r, f, rng.choice([None, "  ", "said", "x" * 800]) if rng.random() < 0.2 else "said", rng.choice(statuses), some(2)) for i in "ab" for r in range(1, 5) for f in ("cause", "mechanism", "impact")]
    claims += [("c", 1, "cause", "said", "observed", ["e1"])]
    extra = [("d", 1, "cause", "said", s, ["e1"]) for s in ["observed"]] + [("d", 1, "mechanism", "said", "observed", ["e1", "e2"]), ("d", 1, "impact", "said", "observed", ["e3"]), ("d", 2, "cause", "said", "inferred", ["e1", "e1"])]
    known += [("d", f"e{k}") for k in range(4)]
    candidates += [("d", 1, ["e1"], ["e3"], None), ("d", 2, ["e1"], None, None)]
    links += [("d", 9, ["e1", "e2"])]
    frames = [spark.createDataFrame(claims + extra, CLAIM), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(links, "incident string, link_id int, supporting_event_ids array<string>"), spark.createDataFrame(known, "incident string, event_id string")]
    roles = grounding.evidence_roles(frames[1], frames[2], frames[3])
    found = grounding.grounded_claims(frames[0], roles, frames[2], frames[3])
    expected = by_hand(claims + extra, candidates, links, known)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == expected
    assert {v[3] for v in expected.values()} == {"supported", "downgraded", "rejected"} and expected["d", 1, "mechanism"][3] == "downgraded"
    assessments = spark.createDataFrame([("d", False), ("c", False), ("a", True), ("z", None)], "incident string, abstain boolean")
    assert {tuple(r) for r in grounding.enforced_abstention(found, assessments).collect()} == {("d", False, None), ("c", True, grounding.NO_CAUSE), ("a", True, grounding.NO_CANDIDATE), ("z", True, grounding.NO_CANDIDATE)}
    assert grounding.grounded_claims(frames[0].limit(0), roles, frames[2], frames[3]).count() == 0
