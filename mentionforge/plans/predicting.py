"""Query of whole predictions. The first word of four letters of a document is its one mention; eleven predictions of twelve break one rule
each, by their id."""

from pyspark.sql import functions as F

from mentionforge.operators import consistency as cs
from mentionforge.operators import contracts as ct
from mentionforge.plans.catalog import query

_FAULTS = ("", "status", "pipeline_complete", "fields", "intent_labels", "sentiment_label", "detector_spans", "occurrences", "detector_coverage", "public_contract_complete", "identity", "stage_counts")


@query("prediction_problems", f"""
SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN []::VARCHAR[] ELSE [([{", ".join(repr(x) for x in _FAULTS)}])[1 + doc_id % 12]] END AS problems FROM documents WHERE regexp_matches(text, '[A-Za-z]{{4,}}')
""")
def prediction_problems(load):
    d = load("documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), "text", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("w")).where("w <> ''")
    k, rev = F.pmod("doc_id", F.lit(12)), ct.revision(F.col("text"))
    start = (F.expr("locate(w, text)") - 1).cast("long")
    span = F.struct(start.alias("start"), (start + F.length("w")).alias("end"))
    ident = ct.occurrence_id(F.col("document_id"), rev, span["start"], span["end"])
    types = dict(x.split(" ", 1) for x in cs.PREDICTION_DDL.split(", "))
    empty = lambda c: F.array().cast(types[c])
    one_map = lambda scores: F.create_map(*[x for n, v in scores.items() for x in (F.lit(n), F.lit(v) if isinstance(v, float) else v)])
    field = lambda value, scores: F.struct(F.lit("success"), value, scores, F.array(), F.lit(None), F.lit(None), F.lit(None))
    word = F.when(k == 3, F.concat("w", F.lit("!"))).otherwise(F.col("w"))
    intents = F.array(F.when(k == 4, F.lit("shared")).otherwise(F.lit("used")))
    feeling = one_map(dict.fromkeys(ct.SENTIMENTS, 0.1) | {"not_expressed": F.lit(0.8)})
    sentiment = F.when(k == 5, F.map_filter(feeling, lambda n, _: n != "mixed")).otherwise(feeling)
    fields = F.array(F.struct(ident, word, span, field(F.array(word), one_map({"software": 0.9})), field(F.array(), one_map({"none": 0.9})), field(intents, one_map({"created": 0.1, "used": 0.9, "shared": 0.2})), field(F.array(F.lit("not_expressed")), sentiment)))
    stage = F.struct(F.lit("success"), F.lit(1), F.when(k == 11, 2).otherwise(1), F.lit(1), F.array())
    detector = F.struct(F.lit("success"), F.array(F.struct(F.lit("SOFTWARE"), span["start"], span["end"], F.col("w"), F.when(k == 6, 1.5).otherwise(0.5))), F.array(F.struct(F.when(k == 8, F.lit("failed")).otherwise(F.lit("success")))))
    occurrence = F.array(F.struct(ident, word, F.array(), intents, F.lit("not_expressed")))
    rows = {
        "text_revision": rev, "schema_version": F.when(k == 10, F.lit("0")).otherwise(F.lit(cs.SCHEMA)), "offset_unit": F.lit(ct.OFFSET_UNIT), "stages": F.map_from_arrays(F.array(*map(F.lit, cs.STAGES)), F.array_repeat(stage, 5)).cast(types["stages"]),
        "pipeline_complete": k != 2, "public_contract_complete": k != 9, "status": F.when(k == 1, F.lit("partial")).otherwise(F.lit("success")), "detector": detector.cast(types["detector"]), "fields": fields.cast(types["fields"]),
        **{c: empty(c) for c in ("links", "alias_pairs", "alias_groups", "exclusions")}, "occurrences": F.when(k == 7, empty("occurrences")).otherwise(occurrence.cast(types["occurrences"])),
    }
    return cs.prediction_problems(d.withColumns(rows)).select("doc_id", "problems")
