"""Review as a fold over a log of decisions: what each decision does to a task's annotation, and why one is refused.

A task's annotation changes by decisions alone, one after another; each names the revision that it was made on, and is refused
if the task has moved on since. Actions are entries of a table; an entry works on a copy and either leaves it changed or
refuses, so a decision counts whole or not at all. Spark deals the log out by task and sorts it; a task reads its decisions as a
stream and holds one annotation at a time."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mentionforge.operators.contracts import FIELDS, INTENT_BITS
from mentionforge.operators.graph import connected, materialize
from mentionforge.session import map_in_arrow

#: States of a version, decisions on an alias, what a batch may do, and what it may hold.
VERSION_STATES = ("explicit", "absent", "ambiguous", "unannotated")
ALIAS_DECISIONS = ("alias", "not_alias", "unresolved")
MOST_OPERATIONS = 200
ITEM_DDL = "task_id string, task string, annotation string, revision bigint, status string"
LEDGER_DDL = "decision_id string, task_id string, seq bigint, outcome string, revision bigint"


class Refusal(Exception):
    """Why a decision is not applied: a code."""


def refuse(when: bool, code: str) -> None:
    if when:
        raise Refusal(code)


read: Callable[[str], object] = json.JSONDecoder().decode
canonical: Callable[[object], str] = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def copied(value):
    """A value of JSON that shares no list and no object with the one that is given; copy.deepcopy takes ten times as long."""
    if type(value) is dict:
        return {k: copied(v) if type(v) in (dict, list) else v for k, v in value.items()}
    return [copied(v) for v in value] if type(value) is list else value


def place(span) -> tuple[int, int] | None:
    return (span["start"], span["end"]) if isinstance(span, dict) and "start" in span and "end" in span else None


def meets(a: dict, b: dict) -> bool:
    return a["start"] < b["end"] and b["start"] < a["end"]


def mention_id(task: dict, span: dict) -> str:
    return f"{task['document_id']}|{task['text_revision']}|{span['start']}:{span['end']}"


def relation_id(task: dict, members: Iterable[str]) -> str:
    return "alias:" + digest([task["document_id"], task["text_revision"], sorted(members)])


def checked_occurrence(task: dict, value) -> dict:
    """An occurrence as it is kept, if the task's text says what it says and its parts agree."""
    try:
        base, region = task["offset_base"], task["annotation_region"]
        said = lambda s: task["text"][s["start"] - base : s["end"] - base]
        span, known, links, intents = value["name_span"], value["known"], value["version_links"], value["intents"]
        right = (
            region["start"] <= span["start"] < span["end"] <= region["end"] and said(span) == value["name"] and set(known) == set(FIELDS) and all(type(x) is bool for x in known.values()),
            value["version_status"] in VERSION_STATES and (value["version_status"] == "explicit") == bool(links and known["versions"]) or value["version_status"] == "ambiguous" and not known["versions"],
            all(x["span"]["start"] < x["span"]["end"] and said(x["span"]) == x["text"] for x in links),
            (intents is None) == (not any(known[b] for b in INTENT_BITS)) and set(intents or ()) <= {*INTENT_BITS, "mentioned"},
            (value["sentiment"] is None) == (not known["sentiment"]),
        )
        refuse(not all(right), "INVALID_OCCURRENCE")
        return {**copied(value), "mention_id": mention_id(task, span), "document_id": task["document_id"]}
    except (KeyError, TypeError, AttributeError) as e:
        raise Refusal("INVALID_OCCURRENCE") from e


class Annotation:
    """A task's annotation under change: occurrences by place, alias relations by id, and the rest as it came. What is changed is copied
    first (own, workflow) or made anew; the annotation that is given stays as it is and lends the others."""

    def __init__(self, task: dict, annotation: dict):
        self.task, self.rest, self.owns_workflow = task, copy.copy(annotation), False
        self.occurrences = {place(o["name_span"]): o for o in self.rest.pop("occurrences", [])}
        layer = self.rest.pop("alias_annotations", None)
        self.relations = None if layer is None else {r["relation_id"]: r for r in layer["relations"]}

    def target(self, operation: dict) -> dict:
        found = self.occurrences.get(place(operation.get("target_name_span")))
        refuse(found is None, "UNKNOWN_OCCURRENCE")
        return found

    def own(self, operation: dict) -> dict:
        """The target, to be changed."""
        found = copied(self.target(operation))
        self.occurrences[place(operation["target_name_span"])] = found
        return found

    def in_use(self, ident: str) -> bool:
        return any(ident in r["member_mention_ids"] for r in (self.relations or {}).values())

    def workflow(self) -> dict:
        if not self.owns_workflow:
            none = {"schema_version": "1.0", "field_reviews": {}, "source_issues": [], "approval": None}
            self.rest["review_workflow"], self.owns_workflow = copied(self.rest.get("review_workflow", none)), True
        return self.rest["review_workflow"]

    def check_aliases(self) -> None:
        """Relations are between mentions that are there, and none denies what a chain of others says."""
        ids, top = {o["mention_id"] for o in self.occurrences.values()}, {}
        if not self.relations:
            return

        def root(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        held = list(self.relations.values())
        for r in held:
            members = r["member_mention_ids"]
            refuse(len(set(members)) != 2 or len(members) != 2 or r["decision"] not in ALIAS_DECISIONS, "INVALID_ALIAS_RECORD")
            refuse(not set(members) <= ids, "ALIAS_MEMBER_UNKNOWN")
            refuse(r.get("preferred_mention_id") is not None and (r["decision"] != "alias" or r["preferred_mention_id"] not in members), "INVALID_ALIAS_RECORD")
            if r["decision"] == "alias":
                top[root(members[0])] = root(members[1])
        refuse(any(r["decision"] == "not_alias" and root(r["member_mention_ids"][0]) == root(r["member_mention_ids"][1]) for r in held), "ALIAS_CONTRADICTION")

    def settle(self) -> None:
        """Coverage anew: a region is complete if it knows every field and so do the occurrences that meet it."""
        spans = [(o["name_span"], all(o["known"].values())) for o in self.occurrences.values()]
        regions, empty = [], []
        for region in self.rest.get("covered_regions", []):
            inside = [whole for span, whole in spans if meets(region, span)]
            sure = all(region["fields"].values())
            regions.append({**region, "status": "complete" if sure and all(inside) else "partial"})
            empty += regions[-1:] if sure and not inside else []
        if regions:
            self.rest["covered_regions"] = regions
        self.rest["status"] = "complete" if regions and not self.rest.get("unresolved_regions") and {r["status"] for r in regions} == {"complete"} else "partial"
        self.rest["complete_negative_regions"] = empty

    def done(self) -> dict:
        out = dict(self.rest, occurrences=[self.occurrences[k] for k in sorted(self.occurrences)])
        if self.relations is not None:
            out["alias_annotations"] = {"schema_version": "1.0", "relations": [self.relations[k] for k in sorted(self.relations)]}
        return out


def _upsert(a: Annotation, op: dict, stamp: dict) -> None:
    new = checked_occurrence(a.task, op.get("value"))
    old = a.target(op) if op.get("target_name_span") is not None else None
    at = place(new["name_span"])
    refuse(at in a.occurrences and a.occurrences[at] is not old, "DUPLICATE_OCCURRENCE")
    if old is not None:
        refuse(old["mention_id"] != new["mention_id"] and a.in_use(old["mention_id"]), "ALIAS_MEMBER_IN_USE")
        del a.occurrences[place(old["name_span"])]
    a.occurrences[at] = {**(old or {}), **new, "review": stamp}


def _remove(a: Annotation, op: dict, stamp: dict) -> None:
    gone = a.target(op)
    refuse(a.in_use(gone["mention_id"]), "ALIAS_MEMBER_IN_USE")
    del a.occurrences[place(gone["name_span"])]


def _accept(a: Annotation, op: dict, stamp: dict) -> None:
    a.own(op)["review"] = stamp


#: What a field is when nobody can say: parts of an occurrence, and the fields that are then not known.
UNRESOLVED = {
    "sentiment": ({"sentiment": None}, ("sentiment",), "sentiment"),
    "versions": ({"version_status": "ambiguous"}, ("versions",), None),
    "intents": ({"intents": None}, INTENT_BITS, "intents"),
}


def _unresolve(a: Annotation, op: dict, stamp: dict) -> None:
    o, field = a.own(op), op.get("field")
    refuse(field not in UNRESOLVED, "UNKNOWN_FIELD")
    parts, unknown, evidence = UNRESOLVED[field]
    o.update(parts, review={**stamp, "status": "unresolved", "reasons": ["unresolved_field"]})
    o["known"].update(dict.fromkeys(unknown, False))
    if evidence:
        o["evidence"][evidence] = []
    checked_occurrence(a.task, o)


def _link(a: Annotation, op: dict, stamp: dict) -> None:
    o = a.own(op)
    o["version_links"].append(copied(op.get("value")))
    o.update(version_status="explicit", review=stamp)
    o["known"]["versions"] = True
    checked_occurrence(a.task, o)


def _unlink(a: Annotation, op: dict, stamp: dict) -> None:
    o = a.own(op)
    refuse(op.get("value") not in o["version_links"], "UNKNOWN_VERSION_LINK")
    o["version_links"].remove(op["value"])
    o["review"] = stamp
    if not o["version_links"]:
        o["version_status"] = "absent" if o["known"]["versions"] else "unannotated"
    checked_occurrence(a.task, o)


def _accept_passage(a: Annotation, op: dict, stamp: dict) -> None:
    refuse(bool((a.rest.get("review_workflow") or {}).get("source_issues")), "SOURCE_ISSUE_BLOCKS_APPROVAL")
    a.rest["human_passage_review"] = {k: stamp[k] for k in ("reviewer", "decision_id", "recorded_at")} | {"fields": ["software"]}
    open_ = [{**r, "fields": dict.fromkeys(FIELDS, False)} for r in a.rest.get("unresolved_regions", [])]
    regions = sorted(a.rest.get("covered_regions", []) + open_, key=lambda r: r["start"])
    regions = [{**r, "fields": {**r["fields"], "software": True}, "human_reviewed_fields": sorted({*r.get("human_reviewed_fields", ()), "software"})} for r in regions]
    a.rest.update(covered_regions=regions, unresolved_regions=[])


def _alias(change: Callable[[dict, dict], None] | None):
    """An action on a recorded relation; None takes it away."""

    def run(a: Annotation, op: dict, stamp: dict) -> None:
        refuse("aliases" not in a.task.get("requested_fields", ()), "ALIAS_TASK_UNSUPPORTED")
        held = copied((a.relations or {}).get(op.get("target_relation_id")))
        refuse(held is None, "UNKNOWN_ALIAS_RELATION")
        if change is None:
            del a.relations[held["relation_id"]]
        else:
            change(held, stamp)
            a.relations[held["relation_id"]] = held

    return run


def _confirm(r: dict, stamp: dict) -> None:
    refuse(r["decision"] != "alias", "ALIAS_NOT_POSITIVE")
    r["review"] = stamp


def _deny(r: dict, stamp: dict) -> None:
    r.update(decision="not_alias", preferred_mention_id=None, review=stamp)


def _doubt(r: dict, stamp: dict) -> None:
    r.update(decision="unresolved", preferred_mention_id=None, review={**stamp, "status": "unresolved", "reasons": ["unresolved_alias"]})


def _upsert_alias(a: Annotation, op: dict, stamp: dict) -> None:
    refuse("aliases" not in a.task.get("requested_fields", ()), "ALIAS_TASK_UNSUPPORTED")
    a.relations = {} if a.relations is None else a.relations
    old, value = op.get("target_relation_id"), op.get("value")
    refuse(old is not None and old not in a.relations, "UNKNOWN_ALIAS_RELATION")
    fields = ("member_mention_ids", "relation_type", "decision", "preferred_mention_id", "evidence_spans")
    refuse(not isinstance(value, dict) or not set(fields) <= value.keys() or not isinstance(value["member_mention_ids"], list), "INVALID_ALIAS_RECORD")
    new = {k: copied(value[k]) for k in fields} | {"member_mention_ids": sorted(map(str, value["member_mention_ids"]))}
    ident = relation_id(a.task, new["member_mention_ids"])
    refuse(ident in a.relations and ident != old, "DUPLICATE_ALIAS_RELATION")
    a.relations.pop(old, None)
    a.relations[ident] = new | {"relation_id": ident, "review": stamp if new["decision"] != "unresolved" else {**stamp, "status": "unresolved", "reasons": ["unresolved_alias"]}}


ALIAS_ACTIONS = {"upsert_alias": _upsert_alias, "accept_alias": _alias(_confirm), "reject_alias": _alias(_deny), "unresolve_alias": _alias(_doubt), "remove_alias": _alias(None)}
#: The twelve actions of a decision.
ACTIONS = {
    "upsert_occurrence": _upsert, "accept_occurrence": _accept, "remove_occurrence": _remove, "mark_field_unresolved": _unresolve, "link_version": _link, "unlink_version": _unlink,
    "accept_passage": _accept_passage, **ALIAS_ACTIONS,
}


def field_value(o: dict, field: str):
    """What a reviewer of a field looks at."""
    parts = {"software": ("name", "name_span"), "versions": ("version_status", "version_links"), "sentiment": ("sentiment",)}
    seen = {k: o[k] for k in parts[field]} if field in parts else {"positive": field in (o["intents"] or ())}
    evidence = "sentiment" if field == "sentiment" else "intents" if field in INTENT_BITS else None
    return {"known": o["known"][field], "value": seen, "evidence": o["evidence"].get(evidence, []) if evidence else []}


def _within(before: dict | None, after: dict, fields: Iterable[str]) -> None:
    """A batch's change of an occurrence keeps to the fields that it names; intents share their evidence."""
    fields = set(fields)
    for f in set(FIELDS) - fields:
        old, new = field_value(before, f) if before else {"known": False}, field_value(after, f)
        if f in INTENT_BITS and fields & set(INTENT_BITS):
            old, new = {**old, "evidence": None}, {**new, "evidence": None}
        refuse(new["known"] if before is None else old != new, "BATCH_OUT_OF_SCOPE")
    refuse(before is None and "software" not in fields, "BATCH_OUT_OF_SCOPE")


def _batch_upsert(a: Annotation, op: dict, stamp: dict) -> None:
    old = a.occurrences.get(place(op.get("target_name_span")))
    _upsert(a, op, stamp)
    o = a.occurrences[place(op["value"]["name_span"])]
    _within(old, o, op.get("fields", ()))
    _stamp_fields(a, o, op, stamp)


def _accept_fields(a: Annotation, op: dict, stamp: dict) -> None:
    o = a.own(op)
    refuse(not all(o["known"].get(f) for f in op.get("fields", ())), "BATCH_CANNOT_CONFIRM_UNKNOWN")
    _stamp_fields(a, o, op, stamp)


def _stamp_fields(a: Annotation, o: dict, op: dict, stamp: dict) -> None:
    """Notes who looked at which value of each field; the occurrence is reviewed once all fields are, as they now stand."""
    reviews = a.workflow()["field_reviews"].setdefault(o["mention_id"], {})
    for f in op.get("fields", ()):
        refuse(f not in FIELDS, "UNKNOWN_FIELD")
        reviews[f] = {k: stamp[k] for k in ("decision_id", "operation_id", "reviewer", "recorded_at")} | {"state": "confirmed" if o["known"][f] else "unresolved", "value_hash": digest(field_value(o, f))}
    seen = all(reviews.get(f, {}).get("state") == "confirmed" and reviews[f]["value_hash"] == digest(field_value(o, f)) for f in a.task.get("requested_fields", FIELDS) if f in FIELDS)
    o["review"] = {**stamp, "status": "human_reviewed" if seen else "unresolved" if not all(o["known"][f] for f in op.get("fields", ())) else "pending"}


def _issue(a: Annotation, op: dict, stamp: dict) -> None:
    refuse(not isinstance(op.get("value"), dict), "WORKFLOW_SOURCE_ISSUE_INVALID")
    a.workflow()["source_issues"].append({**copied(op["value"]), **{k: stamp[k] for k in ("decision_id", "operation_id", "reviewer", "recorded_at")}})


#: The ten actions of an operation of a batch.
BATCH_ACTIONS = {"upsert_occurrence": _batch_upsert, "accept_fields": _accept_fields, "remove_occurrence": _remove, "record_note": lambda a, op, stamp: None, "record_source_issue": _issue, **ALIAS_ACTIONS}
SYSTEM_ACTIONS = ("record_note", "record_source_issue")


def _batch(a: Annotation, event: dict, stamp: dict) -> str:
    """All operations of a batch or none; approval then accepts whatever is there, and the passage."""
    value = event.get("value")
    refuse(not isinstance(value, dict) or value.get("completion") not in ("save", "approve") or type(value.get("proposals_revealed")) is not bool, "BATCH_ENVELOPE_INVALID")
    operations = value.get("operations")
    refuse(not isinstance(operations, list) or len(operations) > MOST_OPERATIONS or not all(isinstance(x, dict) and x.get("operation_id") for x in operations), "BATCH_OPERATIONS_INVALID")
    refuse(len({x["operation_id"] for x in operations}) < len(operations), "BATCH_DUPLICATE_OPERATION_ID")
    approve, system = value["completion"] == "approve", event.get("actor_kind") == "system"
    refuse(event.get("actor_kind") not in ("human", "system") or system and (approve or any(x.get("action") not in SYSTEM_ACTIONS for x in operations)), "BATCH_ACTOR_FORBIDDEN")
    refuse(approve and not value["proposals_revealed"], "BATCH_REVEAL_REQUIRED")
    a.workflow()["approval"] = None

    def run(operation):
        refuse(operation.get("action") not in BATCH_ACTIONS, "UNKNOWN_ACTION")
        BATCH_ACTIONS[operation["action"]](a, operation, {**stamp, "status": "human_reviewed" if operation["action"] in ALIAS_ACTIONS else "pending", "operation_id": operation["operation_id"]})
        a.check_aliases()

    for operation in operations:
        run(operation)
    if not approve:
        return "in_progress"
    refuse(bool(a.workflow()["source_issues"]), "SOURCE_ISSUE_BLOCKS_APPROVAL")
    wanted = [f for f in a.task.get("requested_fields", FIELDS) if f in FIELDS]
    refuse(not all(o["known"][f] for o in a.occurrences.values() for f in wanted) or any(r["decision"] == "unresolved" for r in (a.relations or {}).values()), "BATCH_APPROVAL_NOT_READY")
    for o in list(a.occurrences.values()):
        run({"operation_id": "approval:" + digest([stamp["decision_id"], o["mention_id"]]), "action": "accept_fields", "target_name_span": o["name_span"], "fields": sorted(wanted)})
    for r in list((a.relations or {}).values()):
        run({"operation_id": "approval:" + digest([stamp["decision_id"], r["relation_id"]]), "action": "accept_alias" if r["decision"] == "alias" else "reject_alias", "target_relation_id": r["relation_id"]})
    _accept_passage(a, {}, stamp)
    a.workflow()["approval"] = {k: stamp[k] for k in ("decision_id", "reviewer", "recorded_at")}
    return "reviewed"


def apply(task: dict, annotation: dict, revision: int, status: str, event: dict) -> tuple[dict, str]:
    """The annotation and status after a decision on a task, or Refusal."""
    for k in ("decision_id", "task_id", "reviewer", "reason"):
        refuse(not isinstance(event.get(k), str) or not event[k].strip(), "IDENTITY_AND_REASON_REQUIRED")
    for k in ("document_id", "text_revision"):
        refuse(event.get(k) != task.get(k), "SOURCE_REVISION_MISMATCH")
    refuse(type(event.get("base_annotation_revision")) is not int or event["base_annotation_revision"] != revision, "STALE_REVISION")
    a, action = Annotation(task, annotation), event.get("action")
    approved = (annotation.get("review_workflow") or {}).get("approval")
    stamp = {"status": "human_reviewed", "reasons": [], **{k: event.get(k) for k in ("reviewer", "decision_id", "recorded_at")}}
    if action == "apply_review_batch":
        status = _batch(a, event, stamp)
    else:
        refuse(event.get("actor_kind", "human") != "human", "ACTOR_FORBIDDEN")
        refuse(action not in ACTIONS, "UNKNOWN_ACTION")
        ACTIONS[action](a, event, stamp)
        keeps = action in ALIAS_ACTIONS and status == "reviewed" and not approved
        status = "reviewed" if action == "accept_passage" or keeps else "in_progress"
        if isinstance(a.rest.get("review_workflow"), dict):
            a.workflow()["approval"] = None
    if action not in ALIAS_ACTIONS:
        a.settle()
    if isinstance(a.rest.get("review_workflow"), dict):
        there = {o["mention_id"] for o in a.occurrences.values()}
        a.workflow()["field_reviews"] = {k: v for k, v in a.workflow()["field_reviews"].items() if k in there}
    a.check_aliases()
    return a.done() | {"annotation_revision": revision + 1}, status


class Task:
    """A task as decisions reach it. `seen` holds the digests of applied ones by their ids; those of the last ones are not made until
    they are asked for or FRESH texts are held."""

    FRESH = 256

    def __init__(self, task: str, annotation: str, revision: int, status: str, seen: dict[str, str] | None = None):
        self.task, self.annotation, self.revision, self.status, self.seen, self.fresh = read(task), read(annotation), revision, status, dict(seen or {}), {}

    def mark(self, ident: str) -> str | None:
        """The digest of the applied decision of an id, or None."""
        if ident in self.fresh:
            self.seen[ident] = digest(read(self.fresh.pop(ident)))
        return self.seen.get(ident)

    def decide(self, payload: str) -> str:
        """applied, duplicate (of an applied one, word for word), or the code of a refusal."""
        try:
            event = read(payload)
            refuse(not isinstance(event, dict), "INVALID_DECISION")
            ident = event.get("decision_id")
            if (mark := self.mark(ident)) is not None:
                refuse(mark != digest(event), "DECISION_ID_CONFLICT")
                return "duplicate"
            self.annotation, self.status = apply(self.task, self.annotation, self.revision, self.status, event)
        except Refusal as e:
            return str(e)
        except (json.JSONDecodeError, TypeError):
            return "INVALID_DECISION"
        except (KeyError, AttributeError):
            return "INVALID_ANNOTATION"
        self.revision += 1
        self.fresh[ident] = payload
        if len(self.fresh) >= self.FRESH:
            for held in list(self.fresh):
                self.mark(held)
        return "applied"


_ROWS = "task_id string, seq bigint, decision_id string, outcome string, revision bigint, task string, annotation string, status string"
_TYPES = [pa.int64() if x.endswith("bigint") else pa.string() for x in _ROWS.split(", ")]


def _folder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task_id, seq, decision_id, payload, outcome, task, annotation, revision, status) by task, its item first, to a row for each
    decision and one for the state in which it leaves the task."""
    ident, task = None, None

    def state():
        return ident, None, None, None, task.revision, canonical(task.task), canonical(task.annotation), task.status

    def told(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [c.split()[0] for c in _ROWS.split(", ")])

    for batch in batches:
        out = []
        for task_id, seq, decision_id, payload, outcome, item, annotation, revision, status in zip(*[c.to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns], strict=True):
            if task_id != ident:
                if task:
                    out.append(state())
                ident, task = task_id, None
            if payload is None and item is not None:
                task = Task(item, annotation, revision, status)
            else:
                outcome = "UNKNOWN_TASK" if task is None else "INVALID_DECISION" if payload is None else outcome or task.decide(payload)
                out.append((ident, seq, decision_id, outcome, task.revision if task else None, None, None, None))
        yield told(out)
    if task:
        yield told([state()])


def fold_log(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (ITEM_DDL) after the decisions (decision_id, task_id, seq, payload), and the ledger (LEDGER_DDL): a row for each decision
    with its outcome (applied, duplicate, or why it is refused) and the task's revision then.

    A task's decisions go by seq, then by id and payload. A decision id belongs to the task that its first row names; rows of other tasks
    with it are refused as a conflict. Unknown tasks, payloads that are null or no JSON object, and whatever the table of actions
    refuses leave everything as it was. Items are one row a task; tasks without decisions come out as they are, in canonical JSON.

    Ids that come more than once are found before payloads are moved, by hashes, and looked at alone: a log without any sends its
    payloads once, to their tasks."""
    ids = decisions.where("decision_id is not null").select("decision_id", "task_id", "seq", F.xxhash64("decision_id").alias("h"))
    repeated = materialize(ids.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    claimed = decisions.select("task_id", "seq", "decision_id", "payload", F.lit(None).cast("string").alias("outcome"))
    if not repeated.isEmpty():
        first = F.min(F.struct("seq", "task_id")).over(W.partitionBy("decision_id"))["task_id"]
        several = ids.join(repeated.hint("merge"), "h", "left_semi").withColumn("first", first).where(F.col("first") != F.col("task_id"))
        others = several.select("decision_id", "task_id", F.lit("DECISION_ID_CONFLICT").alias("outcome")).distinct()
        claimed = claimed.drop("outcome").join(others.hint("merge"), ["decision_id", "task_id"], "left")
    claimed = claimed.withColumn("kind", F.lit(1))
    start = items.select("task_id", "task", "annotation", F.col("revision").cast("long").alias("revision"), "status", F.lit(0).alias("kind"))
    spark = items.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # much work for few bytes: not to be coalesced
    rows = start.unionByName(claimed, allowMissingColumns=True).repartition(tasks, "task_id").sortWithinPartitions("task_id", "kind", "seq", "decision_id", "payload")
    out = materialize(map_in_arrow(rows.select("task_id", "seq", "decision_id", "payload", "outcome", "task", "annotation", "revision", "status"), _folder, _ROWS), "folded")
    return out.where("annotation is not null").select(*[c.split()[0] for c in ITEM_DDL.split(", ")]), out.where("annotation is null").select(*[c.split()[0] for c in LEDGER_DDL.split(", ")])


_SPAN = "struct<start:bigint,end:bigint>"
_TASK = f"document_id string, text_revision string, policy_version string, policy_hash string, annotation_region {_SPAN}, context_span {_SPAN}, offset_base bigint, split string, text string, task_id string"
_ANNOTATION = f"annotation_revision bigint, occurrences array<struct<mention_id:string,name:string,name_span:{_SPAN},version_status:string,intents:array<string>,sentiment:string>>, covered_regions array<struct<start:bigint,end:bigint,status:string>>, alias_annotations struct<relations:array<struct<relation_id:string,member_mention_ids:array<string>,decision:string,preferred_mention_id:string>>>"


def reference_tables(items: DataFrame) -> dict[str, DataFrame]:
    """What a snapshot says beside its items: occurrences, coverage, aliases, and alias_groups (task_id, group_id, members), the components of
    relations that say alias, by their smallest member."""
    read = items.select("task_id", F.from_json("task", _TASK).alias("t"), F.from_json("annotation", _ANNOTATION).alias("a"))
    own = ["task_id", "t.document_id", "t.text_revision"]
    aliases = read.select("task_id", F.inline("a.alias_annotations.relations"))
    node = lambda k: F.concat_ws("\n", "task_id", F.col("member_mention_ids")[k])
    roots = connected(aliases.where("decision = 'alias'").select(node(0).alias("a"), node(1).alias("b")))
    part = lambda c, k: F.split_part(c, F.lit("\n"), F.lit(k))
    groups = roots.groupBy("root").agg(F.array_sort(F.collect_list(part(F.col("id"), 2))).alias("members"))
    return {
        "occurrences": read.select(*own, F.inline("a.occurrences")), "coverage": read.select(*own, F.inline("a.covered_regions")), "aliases": aliases,
        "alias_groups": groups.select(part(F.col("root"), 1).alias("task_id"), part(F.col("root"), 2).alias("group_id"), "members"),
    }


def snapshot_problems(items: DataFrame, decisions: DataFrame, role: str) -> DataFrame:
    """(task_id, decision_id, code) of what is wrong with a snapshot: items (ITEM_DDL) and the applied decisions (decision_id, task_id, seq,
    payload) that led to them from revision 1. Tasks are there once, are what their ids say, of the role, and hold their
    text; decisions are there once, are of a task and its text, and their base revisions are an unbroken chain up to the task's."""
    n = lambda *c: F.count("*").over(W.partitionBy(*c))
    i = items.withColumns({"t": F.from_json("task", _TASK), "a": F.from_json("annotation", _ANNOTATION), "twice": n("task_id") > 1})
    owned, context = F.col("t.annotation_region"), F.col("t.context_span")
    nested = (context["start"] >= 0) & (context["start"] <= owned["start"]) & (owned["start"] < owned["end"]) & (owned["end"] <= context["end"]) & (F.col("t.offset_base") == context["start"]) & (F.length("t.text") == context["end"] - context["start"])
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        ("SNAPSHOT_DUPLICATE_TASK", F.col("twice")), ("SNAPSHOT_ITEM_INVALID", bad((F.col("revision") >= 1) & F.col("status").isin("unreviewed", "in_progress", "reviewed") & F.col("a").isNotNull())),
        ("SPLIT_CONFLICT", bad(F.col("t.split") == role)), ("SNAPSHOT_ITEM_IDENTITY_MISMATCH", bad((F.col("t.task_id") == F.col("task_id")) & nested & (F.coalesce("a.annotation_revision", "revision") == F.col("revision")))),
    ]
    of_items = i.select("task_id", F.lit(None).cast("string").alias("decision_id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))).alias("code"))
    payload = "document_id string, text_revision string, decision_id string, task_id string, base_annotation_revision bigint, reviewer string, reason string"
    d = decisions.withColumns({"p": F.from_json("payload", payload), "twice": n("decision_id") > 1, "k": F.row_number().over(W.partitionBy("task_id").orderBy("seq", "decision_id"))})
    tasks = i.groupBy("task_id").agg(F.first("t.document_id").alias("_doc"), F.first("t.text_revision").alias("_rev"), F.max("revision").alias("_last"))
    d = d.join(tasks, "task_id", "left")
    same = (F.col("p.decision_id") == F.col("decision_id")) & (F.col("p.task_id") == F.col("task_id")) & (F.col("p.document_id") == F.col("_doc")) & (F.col("p.text_revision") == F.col("_rev")) & (F.btrim("p.reviewer") != "") & (F.btrim("p.reason") != "")
    there = F.col("_last").isNotNull()
    of = [("SNAPSHOT_DUPLICATE_DECISION", F.col("twice")), ("SNAPSHOT_DECISION_REFERENCE", ~there), ("SNAPSHOT_DECISION_IDENTITY_MISMATCH", there & bad(same)), ("SNAPSHOT_REVISION_CHAIN", there & bad(F.col("p.base_annotation_revision") == F.col("k")))]
    of_decisions = d.select("task_id", "decision_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in of]))).alias("code"))
    length = tasks.join(decisions.groupBy("task_id").agg(F.count("*").alias("n")), "task_id", "left").where(F.col("_last") != F.coalesce("n", F.lit(0)) + 1)
    return of_items.unionByName(of_decisions).unionByName(length.select("task_id", F.lit(None).cast("string").alias("decision_id"), F.lit("SNAPSHOT_REVISION_MISMATCH").alias("code")))
