"""Nested records and parser-driven JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benefica.scale import chunked_lists


def full_records(registrant: DataFrame, reg_id: DataFrame, membership: DataFrame, fields: Sequence[str],
                 page_size: int = 500) -> DataFrame:
    """Registrants with their ids as a map, groups with their members one level down.

    A group longer than ``page_size`` comes as several numbered pages of the same
    record, each with its part of the members.
    """
    ids = reg_id.groupBy("partner_id", "id_type").agg(F.max("value").alias("value")).groupBy("partner_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("id_type", "value")))).alias("reg_ids"))
    record = registrant.select("partner_id", "is_group", *[f for f in fields if f not in ("partner_id", "is_group")])
    record = record.join(ids, "partner_id", "left").withColumn(
        "reg_ids", F.coalesce("reg_ids", F.create_map().cast("map<string,string>")))
    person = record.select(F.col("partner_id").alias("individual_id"), F.struct(
        "partner_id", *[f for f in fields if f not in ("partner_id", "is_group")], "reg_ids").alias("individual"))
    members = membership.join(person, "individual_id").select(
        F.col("group_id").alias("partner_id"), F.struct("individual_id", "kind", "individual").alias("member"),
        "individual_id", "kind")
    pages = chunked_lists(members, ["partner_id"], "member", [F.col("individual_id"), F.col("kind")], page_size,
                          "members").withColumnRenamed("chunk", "page").drop("n")
    return record.join(pages, "partner_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def json_value(df: DataFrame, name: str) -> Column:
    """Dates as ISO text, empty text as NULL, everything else as it is."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    return c


def jsonify(df: DataFrame, parser: Sequence, strict: bool = False) -> Column:
    """JSON text of every row from a parser.

    Entries: "field", "field:target", "field:target=list" (several fields gathered
    into one list), ("field:target", function returning a column), and
    ("field", [parser]) for an array-of-structs or struct field.  Unknown fields
    are skipped, or an error when ``strict``.
    """
    return F.to_json(_struct(df, parser, strict), {"ignoreNullFields": "false"})


def _struct(df: DataFrame, parser: Sequence, strict: bool) -> Column:
    entries: dict[str, Column | list[Column]] = {}
    for entry in parser:
        spec, how = entry if isinstance(entry, tuple) else (entry, None)
        field, _, target = spec.partition(":")
        if field not in df.columns and not callable(how):
            if strict:
                raise KeyError(field)
            continue
        if callable(how):
            value = how(df)
        elif how is not None:
            value = _nested(df.schema[field].dataType, F.col(field), how, strict)
        else:
            value = json_value(df, field)
        key, _, marshaller = (target or field).partition("=")
        if marshaller == "list":
            entries.setdefault(key, []).append(value)
        else:
            entries[key] = value
    return F.struct(*[(F.array(*v) if isinstance(v, list) else v).alias(k) for k, v in entries.items()])


def _nested(kind: T.DataType, value: Column, parser: Sequence[str], strict: bool) -> Column:
    struct = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(struct, T.StructType):
        raise TypeError("a sub-parser needs a struct or an array of structs")
    pairs = []
    for spec in parser:
        field, _, target = spec.partition(":")
        if field in struct.names:
            pairs.append((field, target or field))
        elif strict:
            raise KeyError(field)
    build: Callable[[Column], Column] = lambda x: F.struct(*[x[f].alias(t) for f, t in pairs])
    return F.transform(value, build) if isinstance(kind, T.ArrayType) else build(value)
