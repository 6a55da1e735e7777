"""Experiment configurations out of JSON documents, read as VARIANT: what is not of the right kind becomes a row that says so.

A document is a list of entries, {"configs": [entries]} or {model: [entries]}. Entries are merged over defaults and
coerced to the types of the defaults: whole numbers, numbers, truth values. An entry's model may be one name, or
`*`, empty or missing for every model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import name_of

#: Texts that stand for true.
TRUE = ("1", "true", "yes", "y")


def _spread(documents: DataFrame) -> DataFrame:
    """documents dealt to as many tasks as a shuffle has: a small file of short documents is one task's scan and many times its read to parse."""
    return documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _kind(v: Column) -> Column:
    """ARRAY, OBJECT, or another kind of value; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _raw(entry: Column, key: str) -> Column:
    """The value of a key as text, null for none."""
    return F.try_variant_get(entry, f"$.{key}", "string")


def _coerced(entry: Column, key: str, default) -> Column:
    """The value in the type of the default; null if it does not fit."""
    text = F.trim(_raw(entry, key))
    if isinstance(default, bool):
        number = text.try_cast("double")
        kind = _kind(F.try_variant_get(entry, f"$.{key}", "variant"))
        return F.when(kind == "STRING", F.lower(text).isin(*TRUE)).when(kind == "BOOLEAN", text == "true").otherwise(F.coalesce(number != 0, F.lit(True)))
    number = text.try_cast("double")
    kind = _kind(F.try_variant_get(entry, f"$.{key}", "variant"))
    number = F.when(kind == "BOOLEAN", (text == "true").cast("double")).otherwise(number)
    if isinstance(default, int):  # a number is cut, a text must be whole
        return F.when(kind == "STRING", text.try_cast("long")).otherwise(F.when(F.abs(number) < 2**62, number).cast("long"))
    return number


def _fault(defaults: dict) -> Column:
    """Why typed values are no configuration, null if they are one."""
    bad = F.concat_ws(", ", *(F.when(F.col(k).isNull(), F.lit(k)) for k in defaults))
    scale = F.when(F.col("target_scale") <= 0, "target_scale is not positive") if "target_scale" in defaults else F.lit(None).cast("string")
    return F.coalesce(F.when(bad != "", F.concat(F.lit("no fit: "), bad)), scale)


def entries(documents: DataFrame) -> DataFrame:
    """(path, number, entry, given): the entries of documents (path, value) in their order, from 1; given is the model that an entry stands under.

    A document that is no JSON, or of another form, has one row with a null number.
    """
    docs = _spread(documents.select("path", "value")).select("path", F.try_parse_json("value").alias("doc"))
    kind = _kind(F.col("doc"))
    own = F.try_variant_get("doc", "$.configs", "array<variant>")
    pair = "array<struct<given: string, entry: variant>>"
    single = lambda a: F.transform(a, lambda e: F.struct(F.lit(None).cast("string").alias("given"), e.alias("entry")))
    under = F.flatten(F.transform(F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>")), lambda m: F.when(_kind(m["value"]) == "ARRAY", F.transform(F.try_variant_get(m["value"], "$", "array<variant>"), lambda e: F.struct(m["key"].alias("given"), e.alias("entry")))).otherwise(F.expr(f"cast(array() as {pair})"))))
    found = F.when(kind == "ARRAY", single(F.try_variant_get("doc", "$", "array<variant>"))).when(kind != "OBJECT", None).when(_kind(F.try_variant_get("doc", "$.configs", "variant")) == "ARRAY", single(own)).otherwise(under)
    return docs.select("path", F.posexplode_outer(found).alias("at", "e")).select("path", (F.col("at") + 1).alias("number"), "e.entry", "e.given")


def configurations(documents: DataFrame, models: list[str], defaults: dict) -> DataFrame:
    """(path, number, model, name, <key>..., fault): one row per entry and model that it is for, of the models asked for.

    A fault is null, or says why the row is no configuration: a document of another form, an entry that is no object, a
    value that does not fit its key, a target_scale that is not positive; a model that a document has no entry for has
    a row of its own. Unnamed entries are called custom_ and their number. Values given as null count as not given.
    """
    e = F.col("entry")
    known = entries(documents)
    model = F.coalesce(_raw(e, "model"), F.col("given"))
    wild = model.isNull() | model.isin("", "*")
    values = {k: F.when(_raw(e, k).isNull(), F.lit(d)).otherwise(_coerced(e, k, d)) for k, d in defaults.items()}
    name = F.coalesce(F.nullif(_raw(e, "name"), F.lit("")), F.concat(F.lit("custom_"), F.lpad(F.col("number").cast("string"), 3, "0")))
    form = F.when(F.col("number").isNull(), "no document of configurations").when(F.coalesce(_kind(e) != "OBJECT", F.lit(True)), "entry is no object")
    # a list of the models that were asked for, as literals: the wildcard is an expression, not a join
    every = F.array(*map(F.lit, models))
    targets = F.when(form.isNotNull(), F.array(F.lit(None).cast("string"))).when(wild, every).otherwise(F.array_intersect(F.array(model), every))
    rows = known.select("path", "number", F.explode(targets).alias("model"), F.when(form.isNull(), name).alias("name"), *(v.alias(k) for k, v in values.items()), form.alias("form"))
    rows = rows.withColumn("fault", F.coalesce(F.col("form"), _fault(defaults))).drop("form")
    # what a document lacks: one aggregate, its models compared with those asked for
    have = rows.groupBy("path").agg(F.collect_set(F.when(F.col("fault").isNull(), F.col("model"))).alias("have"), F.max(F.col("number").isNull().cast("int")).alias("broken")).filter("broken = 0")
    lacking = have.select("path", F.explode(F.array_except(every, "have")).alias("model"), F.lit("no configuration").alias("fault"))
    return rows.unionByName(lacking, allowMissingColumns=True)


def by_horizon(documents: DataFrame, model: str) -> DataFrame:
    """(path, horizon, config, fault) of {horizon: {...}} documents; config is a VARIANT.

    Faults: a document that is no object, a key that is no whole number, a config that is no object, another horizon
    inside, another model than the one asked for.
    """
    docs = documents.select("path", F.try_parse_json("value").alias("doc"))
    pairs = F.when(_kind(F.col("doc")) == "OBJECT", F.try_variant_get("doc", "$", "map<string,variant>"))
    rows = docs.select("path", F.explode_outer(pairs).alias("key", "config"))
    horizon = F.trim("key").try_cast("int")
    inner = F.when(_raw(F.col("config"), "horizon").isNull(), horizon).otherwise(_coerced(F.col("config"), "horizon", 0))
    fault = (
        F.when(F.col("key").isNull(), "no document of configurations").when(horizon.isNull(), "horizon is no number").when(F.coalesce(_kind(F.col("config")) != "OBJECT", F.lit(True)), "config is no object")
        .when(F.coalesce(inner != horizon, F.lit(True)), "another horizon inside").when(F.coalesce(_raw(F.col("config"), "model"), F.lit(model)) != model, "another model")
    )
    return rows.select("path", horizon.alias("horizon"), "config", fault.alias("fault"))


def merged(documents: DataFrame, defaults: dict) -> DataFrame:
    """(path, name, <key>..., fault): documents of one object each over the defaults, in their types; name is the file's."""
    doc = F.col("doc")
    rows = _spread(documents.select("path", "value")).select("path", F.try_parse_json("value").alias("doc"))
    values = {k: F.when(_raw(doc, k).isNull(), F.lit(d)).otherwise(_coerced(doc, k, d)) for k, d in defaults.items()}
    rows = rows.select("path", name_of(F.col("path")).alias("name"), *(v.alias(k) for k, v in values.items()), F.when(F.coalesce(_kind(doc) != "OBJECT", F.lit(True)), "no object").alias("form"))
    return rows.withColumn("fault", F.coalesce(F.col("form"), _fault(defaults))).drop("form")


def read_documents(spark, path: str) -> DataFrame:
    """(path, value) of JSON files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
