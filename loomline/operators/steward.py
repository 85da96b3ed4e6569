"""What stewards decide: the queue as tables, and decisions on one case at a time, by rules that need nothing but the case and its keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import registry
from loomline.functions.codes import KEY_PREFIX, LANES, NATIONAL
from loomline.operators import catalog

APPROVALS = 2
KINDS = ("approve_merge", "reject_merge", "resolve_attribute", "split", "suppress")
#: Why a decision is refused -> status and words.
REASONS = {
    "actor_spoofing": (403, "the request names another actor than the one who asks"),
    "four_eyes": (422, "a second person has to approve"),
    "empty_key": (422, "taking every code would leave the key empty"),
    "unowned_codes": (422, "a split takes at least one code that the key holds"),
    "cross_lane": (422, "the decision crosses lanes"),
    "duplicate_keys": (422, "the keys of a merge are different"),
    "case_required": (422, "a case and the offset of its evidence are needed"),
    "wrong_target": (409, "the decision is not about the case's subject"),
    "stale": (409, "the evidence has changed since"),
    "closed": (409, "the case is closed"),
    "missing": (409, "there is no such case"),
    "wrong_offset": (409, "the offset is not that of the case's evidence"),
    "missing_target": (409, "the key is not established any more"),
    "not_a_repair": (422, "only an open repair case can be split"),
    "not_derived": (422, "the description is not derived for this product"),
    "invalid_target": (422, "no such subject can be reviewed"),
    "unknown_candidate": (422, "the value is none of the reviewed candidates"),
    "unknown_kind": (422, "a decision is one of " + ", ".join(KINDS)),
}


class Refused(Exception):
    def __init__(self, reason: str):
        super().__init__(REASONS[reason][1])
        self.reason, self.status = reason, REASONS[reason][0]


def digest(evidence: object) -> str:
    return hashlib.sha256(json.dumps(evidence, sort_keys=True, separators=(",", ":"), default=sorted).encode()).hexdigest()


@dataclass
class Case:
    """A review case: its subject (kind and parts), the digest and offset of the evidence it was opened on, and who endorsed what."""

    id: str
    subject: tuple
    digest: str
    offset: int
    candidates: tuple = ()
    open: bool = True
    endorsements: dict[str, object] = field(default_factory=dict)


def subject_text(subject: tuple) -> str:
    kind, *rest = subject
    if kind == "merge":
        return "merge:" + "+".join(rest[0])
    if kind == "attr":
        return f"attr:{rest[0]}/{rest[1]}"
    return f"{kind}:{'/'.join(map(str, rest))}"


def lane_of_key(key: str) -> str:
    prefix = key.rpartition("_")[0]
    return next((lane for lane, p in KEY_PREFIX.items() if p == prefix), "product")


def _code_lane(code: str) -> str | None:
    scheme = code.partition(":")[0]
    return None if scheme == "uuid" else LANES.get(scheme, "product")


def approved(members: dict[str, Iterable[str]], keys: Iterable[str], by: str, reason: str | None = None) -> list[dict]:
    """The events of a merge: evidence that different national codes of one scheme are the same, for every pair across the keys; the merge
    into the least key; its members; the verdict."""
    keys = sorted(keys)
    pairs = {tuple(sorted((a, b))) for x, y in combinations(keys, 2) for a in members.get(x, ()) for b in members.get(y, ()) if a != b and a.partition(":")[0] == b.partition(":")[0] and a.partition(":")[0] in NATIONAL}
    same = [{"type": "claim", "kind": "identity_evidence", "source": "steward", "relation": "same", "code": a, "to": b, "by": by, "reason": reason} for a, b in sorted(pairs)]
    union = sorted({c for k in keys for c in members.get(k, ())})
    return same + [{"type": "merged", "from": keys, "into": keys[0]}, {"type": "members_changed", "key": keys[0], "codes": union}, _verdict(("merge", tuple(keys)), "approved", by, reason)]


def _verdict(subject: tuple, decision: str, by: str, reason: str | None) -> dict:
    return {"type": "decision", "subject": subject_text(subject), "decision": decision, "by": by, "reason": reason}


def carved(members: dict[str, Iterable[str]], key: str, groups: Iterable[Iterable[str]], following: int, by: str, reason: str | None = None) -> list[dict]:
    """The events of a split: each group's codes that the key holds go to a new key, numbered from ``following``; the rest stay."""
    held, into = set(members.get(key, ())), []
    prefix = KEY_PREFIX[lane_of_key(key)]
    kept = set(held)
    for n, group in enumerate(groups):
        own = held & set(group)
        into.append({"key": f"{prefix}_{following + n}", "codes": sorted(own)})
        kept -= own
    return [{"type": "split", "key": key, "codes": sorted(kept), "into": into}, _verdict(("split", key), "approved", by, reason)]


def mark_shared(code: str, by: str) -> list[dict]:
    return [_verdict(("code", code), "shared", by, None)]


def resolve_collision(key: str, product: object, by: str) -> list[dict]:
    return [_verdict(("collision", key), f"product {product}", by, None)]


def decide(request: dict, actor: str, case: Case | None, evidence: object, members: dict[str, Iterable[str]], following: int = 1, derived: bool = True) -> tuple[str, list[dict]]:
    """(what was applied, its events) of a request on a case, or Refused. ``evidence`` is the subject's evidence now, ``members`` the codes
    of the keys it names, ``following`` the next key's number, ``derived`` whether a pair to suppress is shown at present.

    Merges, splits and suppressions take APPROVALS different people: the first request only endorses. The case remembers endorsements and
    closes with its verdict.
    """
    kind = request.get("kind")
    if kind not in KINDS:
        raise Refused("unknown_kind")
    if request.get("by", actor) != actor:
        raise Refused("actor_spoofing")
    if not isinstance(request.get("case_id"), str) or type(request.get("evidence_offset")) is not int:
        raise Refused("case_required")
    if case is None or case.id != request["case_id"]:
        raise Refused("missing")
    if not case.open:
        raise Refused("closed")
    if case.offset != request["evidence_offset"]:
        raise Refused("wrong_offset")
    if digest(evidence) != case.digest:
        raise Refused("stale")
    reason = (request.get("reason") or "").strip() or None if isinstance(request.get("reason"), str) else None

    if kind in ("approve_merge", "reject_merge"):
        keys = list(request.get("keys", ()))
        if len(set(keys)) != len(keys):
            raise Refused("duplicate_keys")
        if case.subject != ("merge", tuple(sorted(keys))):
            raise Refused("wrong_target")
        if kind == "reject_merge":
            case.open = False
            return kind, [_verdict(case.subject, "rejected", actor, reason)]
        first = _endorse(case, actor, None)
        if first:
            return "propose_merge", [first, {"type": "merge_endorsed", "keys": sorted(keys), "by": actor, "reason": reason}]
        return kind, [_endorsement(case, actor), *approved(members, keys, actor, reason)]

    if kind == "resolve_attribute":
        if case.subject != ("attr", request.get("key"), request.get("field")):
            raise Refused("wrong_target")
        if request.get("value") not in [v for _, v in case.candidates]:
            raise Refused("unknown_candidate")
        case.open = False
        return kind, [_verdict(case.subject, f"pick {request['value']}", actor, reason)]

    if kind == "split":
        key, wanted = request.get("key"), list(request.get("codes", ()))
        if case.subject[0] != "split":
            raise Refused("not_a_repair")
        if case.subject != ("split", key):
            raise Refused("wrong_target")
        if key not in members:
            raise Refused("missing_target")
        held = set(members[key])
        if held <= set(wanted):
            raise Refused("empty_key")
        if not held & set(wanted):
            raise Refused("unowned_codes")
        if any(lane not in (None, lane_of_key(key)) for lane in map(_code_lane, wanted)):
            raise Refused("cross_lane")
        if actor in case.endorsements:
            raise Refused("four_eyes")
        if case.endorsements and next(iter(case.endorsements.values())) != sorted(wanted):
            raise Refused("wrong_target")
        first = _endorse(case, actor, sorted(wanted))
        return ("propose_split", [first]) if first else (kind, [_endorsement(case, actor), *carved(members, key, [wanted], following, actor, reason)])

    pair = ("suppress", request.get("from"), request.get("to"))
    if case.subject != pair:
        raise Refused("wrong_target")
    if not derived:
        raise Refused("not_derived")
    first = _endorse(case, actor, pair)
    if first:
        return "propose_suppress", [first]
    edge = {"type": "claim", "kind": "edge", "source": "steward", "code": pair[1], "relation": "suppress", "to": pair[2]}
    return kind, [_endorsement(case, actor), edge, _verdict(pair, "approved", actor, reason)]


def _endorsement(case: Case, actor: str) -> dict:
    return {"type": "review_case_endorsed", "case_id": case.id, "principal": actor, "evidence_offset": case.offset}


def _endorse(case: Case, actor: str, proposal: object) -> dict | None:
    """The first endorsements as an event; null once they suffice, which closes the case. Nobody endorses twice."""
    if actor in case.endorsements:
        raise Refused("four_eyes")
    case.endorsements[actor] = proposal
    if len(case.endorsements) < APPROVALS:
        return _endorsement(case, actor)
    case.open = False
    return None


# The queue.
def bridges(proposals: DataFrame, members: DataFrame, live: DataFrame) -> DataFrame:
    """keys, source, ref, recorded_at, owned: the listings whose codes are held by two or more keys of a proposal(keys), each code with the
    least key that holds it. Listings meet keys by code, so no pair of keys is formed."""
    each = proposals.select("keys", F.explode("keys").alias("key")).join(members.select("key", "code"), "key")
    listed = live.where("kind = 'identity'").select("slot", "source", "ref", "recorded_at", F.explode("codes").alias("code"))
    met = each.join(listed, "code")
    spanning = met.groupBy("keys", "slot").agg(F.countDistinct("key").alias("n")).where("n >= 2").select("keys", "slot")
    whole = listed.join(spanning, "slot")
    owner = each.groupBy("keys", "code").agg(F.min("key").alias("owner"))
    tagged = whole.join(owner, ["keys", "code"], "left")
    one = F.struct(registry.code_order(F.col("code")).alias("o"), "code", "owner")
    return tagged.groupBy("keys", "slot", "source", "ref", "recorded_at").agg(F.array_sort(F.collect_set(one)).alias("x")).select("keys", "source", "ref", "recorded_at", F.transform("x", lambda x: F.struct(x["code"].alias("code"), x["owner"].alias("owner"))).alias("owned"))


def codes_with_sources(members: DataFrame, live: DataFrame) -> DataFrame:
    """lane, key, code, sources: who claims each code of a key at present."""
    said = live.where("kind = 'identity'").select("source", F.explode("codes").alias("code")).groupBy("code").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return members.join(said, "code", "left").select("lane", "key", "code", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def latest(events: DataFrame, subject: str = "subject") -> DataFrame:
    """The last event of each subject."""
    by = W.partitionBy(subject).orderBy(F.desc("order"))
    return events.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def open_items(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flags(subject, order, …) that no later verdict(subject, order, …) settles, the first of each subject since then."""
    last = verdicts.groupBy("subject").agg(F.max("order").alias("settled"))
    left = flags.join(last, "subject", "left").where("settled IS NULL OR order > settled").drop("settled")
    by = W.partitionBy("subject").orderBy("order")
    return left.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def answered(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every flag with the last verdict on its subject (decision, by, reason), or null."""
    last = latest(verdicts).select("subject", "decision", "by", "reason")
    return flags.join(last, "subject", "left")


def picks(verdicts: DataFrame, prefix: str) -> DataFrame:
    """subject, decision, by of the last verdict on each subject that begins with ``prefix`` (``attr:`` or ``collision:``)."""
    return latest(verdicts.where(F.startswith("subject", F.lit(prefix)))).select("subject", "decision", "by")


def shared_codes(verdicts: DataFrame) -> DataFrame:
    """code: those that stewards declared shared."""
    return verdicts.where("decision = 'shared' AND subject LIKE 'code:%'").select(F.expr("substring(subject, 6)").alias("code")).distinct()


def repairs(merges: DataFrame, members: DataFrame) -> DataFrame:
    """key, merged_from: established keys that others were merged into, directly or not: what a split could repair."""
    from loomline.operators import ledger

    ends = ledger.redirects(merges).groupBy(F.col("survivor").alias("key")).agg(F.array_sort(F.collect_set("key")).alias("merged_from"))
    return ends.join(members.select("key").distinct(), "key", "left_semi")


def ties(members: DataFrame, live: DataFrame, policy: catalog.Policy, settled: DataFrame | None = None) -> DataFrame:
    """subject, key, field, candidates: attributes that priority cannot decide, without the settled subjects."""
    found = catalog.attributes(members, live, policy).where("status = 'needs_review'").select(F.concat(F.lit("attr:"), "key", F.lit("/"), "field").alias("subject"), "key", "field", "candidates")
    return found if settled is None else found.join(settled.select("subject").distinct(), "subject", "left_anti")
