"""Data Vault model derived from a column catalog: business keys, hubs, links, satellites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlvault.operators.ordered import first_by
from etlvault.plans.mapping import PII_WORDS_VAULT, contains_any

# Fixed values of the naming convention.
PREFIXES = "SRC_|TGT_|STG_|DIM_|FACT_|ODS_|RAW_"
KEY_SUFFIXES = "_ID|_CODE|_KEY|_NUM|_NO"
KEY_SUFFIXES_EXTENDED = "_ID|_KEY|_NO|_CODE|_NUM|_NBR"
TECHNICAL = ["RECORD_SOURCE", "RSRC", "LDTS"]
LOAD_DATE_COLUMN = "LOAD_DATE"
SHARE = 1000  # about how many children of a stem meet its parents in one group


def entity_name(table: Column) -> Column:
    """Table name without one layer prefix, upper-case."""
    return F.upper(F.regexp_replace(table, f"(?i)^(?:{PREFIXES})", ""))


def last_part(table: Column) -> Column:
    """Other entity form: the part after the last dot."""
    return F.upper(F.substring_index(table, ".", -1))


def source_suffix(table: Column) -> Column:
    return F.regexp_replace(F.upper(table), "^SRC_", "")


def hub_name(entity: Column) -> Column:
    return F.concat(F.lit("HUB_"), F.upper(entity))


def link_name(a: Column, b: Column) -> Column:
    return F.concat(F.lit("LNK_"), F.upper(a), F.lit("_"), F.upper(b))


def satellite_name(entity: Column, table: Column) -> Column:
    return F.concat(F.lit("SAT_"), F.upper(entity), F.lit("_"), source_suffix(table))


def hash_key_name(entity: Column) -> Column:
    return F.concat(F.upper(entity), F.lit("_HK"))


def business_key_name(entity: Column) -> Column:
    return F.concat(F.upper(entity), F.lit("_BK"))


def hash_diff_name(entity: Column, table: Column) -> Column:
    return F.concat(F.upper(entity), F.lit("_"), source_suffix(table), F.lit("_HASHDIFF"))


def sanitise(name: Column) -> Column:
    """Identifier form: other characters to underscores, none at the ends."""
    return F.trim(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), F.lit("_"))


def type_label(data_type: Column) -> Column:
    """Plain label of a SQL type; DATETIME meets the date test first."""
    t = F.upper(data_type)
    return (F.when(contains_any(t, ["VARCHAR", "CHAR", "TEXT", "STRING", "NVARCHAR"]), "string")
            .when(contains_any(t, ["NUMBER", "NUMERIC", "DECIMAL", "FLOAT", "DOUBLE"]), "float")
            .when(contains_any(t, ["INT", "INTEGER", "BIGINT", "SMALLINT"]), "int")
            .when(t.contains("DATE"), "date")
            .when(contains_any(t, ["TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"]), "datetime")
            .when(contains_any(t, ["BOOL", "BIT"]), "boolean").otherwise("string"))


def _source_columns(catalog: DataFrame) -> DataFrame:
    return catalog.filter("role = 'source'")


def business_keys(catalog: DataFrame, prefer_primary: bool = False, suffixes: str = KEY_SUFFIXES) -> DataFrame:
    """Per tool and table the ordered, distinct business keys.

    Primary columns and columns with a key suffix; without any, the first column.
    ``prefer_primary`` keeps only the primary ones where a table has them.
    """
    primary = F.upper("key_type").contains("PRIMARY")
    keyed = primary | F.regexp_like("column_name", F.lit(f"(?i)(?:{suffixes})$"))
    entry = F.struct("ordinal", "column_name")
    grouped = _source_columns(catalog).groupBy("tool", "table_name").agg(
        F.min(F.struct("source_file", "position")).alias("home"),
        F.collect_list(F.when(keyed, entry)).alias("k"), F.collect_list(F.when(primary, entry)).alias("p"),
        F.min(entry).getField("column_name").alias("first"))
    picked = F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("k")) if prefer_primary else F.col("k")
    names = F.array_distinct(F.transform(F.sort_array(picked), lambda e: e["column_name"]))
    return grouped.select("tool", "table_name", "home.source_file", "home.position", entity_name(F.col("table_name")).alias("entity"),
                          F.when(F.size(names) > 0, names).otherwise(F.array("first")).alias("business_keys"))


def build_hubs(keys: DataFrame, hash_algorithm: str = "md5") -> DataFrame:
    """One hub per entity; the first table by tool, file and position gives its keys."""
    order = ["tool", "source_file", "position", "table_name"]
    first = first_by(keys.select("entity", *order, "business_keys"), ["entity"], order)
    e = F.col("entity")
    return first.select(hub_name(e).alias("hub_name"), "entity", F.col("table_name").alias("source_table"),
                        hash_key_name(e).alias("hash_key"), "business_keys", F.lit(LOAD_DATE_COLUMN).alias("ldts"),
                        F.lit("RECORD_SOURCE").alias("rsrc"), F.lit(hash_algorithm).alias("hash_algorithm"))


def build_links(catalog: DataFrame, hash_algorithm: str = "md5") -> DataFrame:
    """Links from ``<ENTITY>_ID`` columns of another entity's table; each pair once, in name order."""
    own = entity_name(F.col("table_name"))
    other = F.regexp_extract(F.upper("column_name"), "^([A-Z_]+?)_ID$", 1)
    pairs = _source_columns(catalog).select(own.alias("a"), other.alias("b")).filter("b <> '' AND a <> b")
    pairs = pairs.select(F.least("a", "b").alias("entity_a"), F.greatest("a", "b").alias("entity_b")).distinct()
    a, b = F.col("entity_a"), F.col("entity_b")
    return pairs.select(link_name(a, b).alias("link_name"), "entity_a", "entity_b",
                        F.concat(link_name(a, b), F.lit("_HK")).alias("hash_key"), hash_key_name(a).alias("hub_a_hk"),
                        hash_key_name(b).alias("hub_b_hk"), F.lit(LOAD_DATE_COLUMN).alias("ldts"),
                        F.lit("RECORD_SOURCE").alias("rsrc"), F.lit(hash_algorithm).alias("hash_algorithm"))


def build_key_pair_links(keys: DataFrame) -> DataFrame:
    """Other link form: the first two business keys of a table name the linked entities."""
    parts = F.transform(F.slice("business_keys", 1, 2), lambda k: F.replace(F.replace(k, F.lit("_ID"), F.lit("")), F.lit("_KEY"), F.lit("")))
    return keys.filter(F.size("business_keys") >= 2).select(
        F.concat(F.lit("LNK_"), F.array_join(parts, "_")).alias("table_name"), F.col("table_name").alias("source_table"),
        F.transform(parts, lambda e: F.concat(F.lit("HK_"), e)).alias("fk_hash_keys"))


def build_satellites(catalog: DataFrame, keys: DataFrame, hash_algorithm: str = "md5") -> DataFrame:
    """Per source table the non-key, non-technical columns with their PII flag; none, no satellite.

    A name claimed by tables of several tools stays with the first tool.
    """
    columns = _source_columns(catalog).join(keys.select("tool", "table_name", "entity", "business_keys"), ["tool", "table_name"])
    payload = columns.filter(~F.array_contains("business_keys", F.col("column_name"))
                             & ~F.upper("column_name").isin(LOAD_DATE_COLUMN, *TECHNICAL))
    attribute = F.struct("ordinal", F.col("column_name").alias("name"), "data_type", "nullable",
                         contains_any(F.lower("column_name"), PII_WORDS_VAULT).alias("pii"))
    grouped = payload.groupBy("tool", "table_name", "entity").agg(F.sort_array(F.collect_list(attribute)).alias("attributes"))
    e, t = F.col("entity"), F.col("table_name")
    named = grouped.select(satellite_name(e, t).alias("sat_name"), "tool", "entity", t.alias("source_table"),
                           hash_key_name(e).alias("hub_hash_key"), hash_diff_name(e, t).alias("hashdiff"), "attributes",
                           F.lit(LOAD_DATE_COLUMN).alias("ldts"), F.lit("RECORD_SOURCE").alias("rsrc"),
                           F.lit(hash_algorithm).alias("hash_algorithm"))
    return first_by(named, ["sat_name"], ["tool", "source_table"])


def _stems_and_pieces(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, stem) of the non-key ``…_ID`` columns, and (parent, stem) of the substrings of table names.

    The substring test becomes an equi join: table names are cut into their distinct
    substrings of the lengths that stems have, which the stems then meet by hash.
    """
    columns = _source_columns(catalog).select(sanitise(last_part(F.col("table_name"))).alias("child"), "column_name", "key_type")
    stem = F.upper(F.replace(F.col("column_name"), F.lit("_ID"), F.lit("")))
    stems = columns.filter(F.col("column_name").endswith("_ID") & ~F.upper("key_type").contains("PRIMARY") & (stem != "")).select(
        "child", stem.alias("stem")).distinct()
    # no longer a list than the longest column name
    lengths = stems.agg(F.collect_set(F.length("stem"))).scalar()
    n = F.length("parent")
    names = columns.select(F.col("child").alias("parent")).distinct().select("parent", F.explode(lengths).alias("size")).filter(F.col("size") <= n)
    cuts = F.transform(F.sequence(F.lit(1), n - F.col("size") + 1), lambda i: F.substring(F.upper("parent"), i, F.col("size")))
    return stems, names.select("parent", F.explode(F.array_distinct(cuts)).alias("stem"))


def relationships(catalog: DataFrame) -> DataFrame:
    """One-to-many pairs: a non-key ``…_ID`` column whose stem occurs in a table's name.

    A stem of many children and parents gives all their pairs; ``relationship_ends`` holds the same links in
    rows that grow with the tables. The pairs themselves are only streamed: a pair of several stems is kept at the
    first of them, so none is shuffled, and the children of a stem are dealt in shares that each meet its parents.
    """
    stems, pieces = _stems_and_pieces(catalog)
    # a child has no more stems than columns
    shares = stems.groupBy("child").agg(F.sort_array(F.collect_list("stem")).alias("all")).select(
        "child", F.posexplode("all").alias("at", "stem"), "all").select("child", "stem", F.slice("all", 1, F.col("at")).alias("__before"))
    sizes = stems.groupBy("stem").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("__shares"))
    children = shares.join(sizes, "stem").select("stem", F.pmod(F.xxhash64("child"), "__shares").cast("int").alias("__share"), "child", "__before")
    parents = pieces.join(sizes, "stem").select("stem", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)).alias("__share"), "parent")
    spark = catalog.sparkSession
    # the sides are small and their pairs many, so the planner's sizes would leave the join to a few tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = children.repartition(parts, "stem", "__share").join(parents.repartition(parts, "stem", "__share"), ["stem", "__share"])
    earlier = F.exists("__before", lambda s: F.upper("parent").contains(s))
    return pairs.filter((F.size("__before") == 0) | ~earlier).select("parent", "child")


def relationship_ends(catalog: DataFrame) -> DataFrame:
    """(stem, role, table_name, n_linked): the child and the parent tables of every stem that links some.

    Each child of a stem relates to each of its parents; ``n_linked`` counts the tables at the other end. Only
    counts per stem are joined, so a stem that all tables share costs one row per table and end.
    """
    stems, pieces = _stems_and_pieces(catalog)
    pieces = pieces.join(stems.select("stem").distinct(), "stem", "left_semi")
    ends = (stems.select("stem", F.lit("child").alias("role"), F.col("child").alias("table_name"))
            .unionByName(pieces.select("stem", F.lit("parent").alias("role"), F.col("parent").alias("table_name"))))
    is_child = F.col("role") == "child"
    sizes = ends.groupBy("stem").agg(F.count_if(is_child).alias("__children"), F.count_if(~is_child).alias("__parents"))
    return (ends.join(sizes.filter("__children > 0 and __parents > 0"), "stem")
            .select("stem", "role", "table_name", F.when(is_child, F.col("__parents")).otherwise(F.col("__children")).alias("n_linked")))


def key_marker(target_column: Column, key_type: Column) -> Column:
    """PK, FK or empty, as the relation tables show it."""
    return F.when(F.upper(key_type).contains("PRIMARY"), "PK").when(
        target_column.endswith("_ID") | target_column.endswith("_KEY"), "FK").otherwise("")
