"""Schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

#: The append-only log: wording p, item i, response r (null: the call failed), tokens n, milliseconds ms, error e.
RESPONSE = _struct(p=LONG, i=STRING, r=STRING, n=LONG, ms=LONG, e=STRING)
#: The same with ``at``, the microsecond of the append: of several records of a call the last counts.
LOG = T.StructType([*RESPONSE, T.StructField("at", LONG)])
ITEM = _struct(task=STRING, ord=INT, key=STRING, slots=T.MapType(STRING, STRING), answer=STRING)
WORDING = _struct(id=LONG, style=STRING, text=STRING, source=STRING)
POOL = _struct(
    task=STRING, canonical=STRING, generated_at=STRING, raw_candidates=LONG, duplicates_dropped=LONG,
    rejected=T.ArrayType(_struct(text=STRING, reason=STRING)), paraphrases=T.ArrayType(WORDING),
)
RUN = _struct(at=STRING, model=STRING, task=STRING, new=LONG, errors=LONG, already_done=LONG, seconds=DOUBLE, calls_per_second=DOUBLE)
RUN_META = _struct(
    task=STRING, model=STRING, options=_struct(temperature=DOUBLE, top_p=DOUBLE, seed=LONG, num_predict=LONG), items=INT, runs=T.ArrayType(RUN),
)
JUDGEMENT = _struct(id=LONG, verdict=STRING, reason=STRING, text=STRING)
EQUIVALENCE = _struct(
    task=STRING, judge_model=STRING, judged=_struct(n=LONG, equivalent=LONG, unjudged=LONG, rate=DOUBLE),
    backtranslation=_struct(n=LONG, equivalent=LONG, rate=DOUBLE, slots_survived=LONG), structural_rejections=LONG,
    equivalent_ids=T.ArrayType(LONG), judgements=T.ArrayType(JUDGEMENT),
)
REPEAT = _struct(
    task=STRING, model=STRING, checked_at=STRING, n=LONG, identical=LONG, rate=DOUBLE,
    examples_of_disagreement=T.ArrayType(_struct(p=LONG, i=STRING, first=STRING, second=STRING)),
)
