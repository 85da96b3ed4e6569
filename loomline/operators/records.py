"""Source records, revised as a whole: each request names the revision it builds on and is taken, known already or refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM = "struct<slot: string, kind: string, codes: array<string>, value: string>"
ANSWER = "source string, ref string, seq bigint, status int, outcome string, reason string, active boolean, slots array<string>"


class Refused(Exception):
    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status, self.reason = status, reason


def next_claims(record: dict | None, operation: str, claims: dict, removed: list[str]) -> tuple[bool, dict]:
    """Whether the record is active after an operation, and its claims by slot. A withdrawn record keeps those it had."""
    if record is None:
        allowed = {"replace"}
    elif record["active"]:
        allowed = {"replace", "patch", "withdraw"}
    else:
        allowed = {"reactivate"}
    if operation not in allowed:
        raise Refused(409, f"{operation} is not possible: only {', '.join(sorted(allowed))}")
    if operation == "withdraw":
        if claims or removed:
            raise Refused(422, "withdraw takes neither claims nor removed slots")
        return False, record["claims"]
    kept = {k: v for k, v in record["claims"].items() if k not in removed} if operation == "patch" else {}
    after = kept | claims
    identities = [c for c in after.values() if c["kind"] == "identity"]
    if len(identities) != 1:
        raise Refused(422, "an active record has exactly one identity claim")
    if identities[0]["codes"] is None or not len(identities[0]["codes"]):
        raise Refused(422, "an active record's identity claim has a code")
    return True, after


def answer(record: dict | None, r) -> tuple[dict | None, str]:
    """The record after a request, and 'revised' or 'replay'."""
    if not all(x and x.strip() for x in (r.source, r.ref, r.revision)):
        raise Refused(422, "source, ref and revision have text")
    if r.wrong_interval:
        raise Refused(422, "valid_from is a date, and valid_to, if any, a later one")
    if record is not None and record["revision"] == r.revision:
        if record["fingerprint"] == r.fingerprint:
            return record, "replay"
        raise Refused(409, "the revision exists with other content")
    if r.base_revision != (record["revision"] if record else None):
        raise Refused(412, "the base revision is not the current one")
    claims = {c["slot"]: c for c in (r.claims if r.claims is not None else [])}
    active, after = next_claims(record, r.operation, claims, list(r.removed if r.removed is not None else []))
    return {"revision": r.revision, "fingerprint": r.fingerprint, "active": active, "claims": after}, "revised"


def revise(requests: DataFrame) -> DataFrame:
    """An answer for each of requests(source, ref, seq, operation, revision, base_revision, valid_from, valid_to, claims, removed).

    The requests of a record (source, ref) are answered by seq. 200: taken, or a replay of the current revision; 409: the operation
    is not possible in the record's state, or the revision exists with other content; 412: another revision is current; 422: the
    request itself is wrong. ``active`` and ``slots`` are the record's after the answer. One shuffle by record; requests stream
    through a task in order, which holds one record's current claims only, however many requests a record has.
    """
    content = F.to_json(F.struct("source", "ref", "revision", "base_revision", "operation", F.array_sort("claims").alias("claims"), F.array_sort(F.array_distinct("removed")).alias("removed"), "valid_from", "valid_to"), {"ignoreNullFields": "false"})
    wrong = F.col("valid_from").isNull() | F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False))
    names = ["source", "ref", "seq", "operation", "revision", "base_revision", "claims", "removed"]
    rows = requests.select(*names, F.sha2(content, 256).alias("fingerprint"), wrong.alias("wrong_interval"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, record = None, None
        for batch in batches:
            out = []
            for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if (r.source, r.ref) != at:
                    at, record = (r.source, r.ref), None
                try:
                    record, outcome = answer(record, r)
                    said = (200, outcome, None)
                except Refused as e:
                    said = (e.status, "refused", e.reason)
                out.append((r.source, r.ref, r.seq, *said, bool(record and record["active"]), sorted(record["claims"]) if record else []))
            yield pd.DataFrame(out, columns=["source", "ref", "seq", "status", "outcome", "reason", "active", "slots"])

    return rows.repartition("source", "ref").sortWithinPartitions("source", "ref", "seq").mapInPandas(run, ANSWER)
