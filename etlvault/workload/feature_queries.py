"""Feature, anomaly and model queries over events, documents, pages and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.operators import anomaly, features
from etlvault.session import cut_lineage
from etlvault.workload.tables import table, wide

NUMERIC, CATEGORICAL = ["value", "hour", "day_of_week", "k", "user_id"], ["event_type", "user_bucket"]
TASK_ROWS = 200_000


def email_domains(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents").select("doc_id", features.email_domain(F.col("text")).alias("email_domain"))
    return features.bucket_top_k(docs, "email_domain", 5)


def page_hosts(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return features.bucket_top_k(hosts, "host", 10, "host_bucket").groupBy("host_bucket").agg(F.count("*").alias("pages"))


def event_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(features.hour("ts").alias("hour"), features.day_of_week("ts").alias("day_of_week")).agg(F.count("*").alias("events"))


def policy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    deleted = F.when(F.col("event_type") == "error", "TRUE").otherwise("FALSE")
    violation = features.policy_violation(F.hour("ts"), deleted)
    label = (F.col("value") > 20).cast("int")
    return e.select("event_id", violation.alias("policy_violation"), features.reward(violation, label).alias("reward"))


def coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", features.coerce_number(F.get_json_object("props", "$.k")).alias("k"),
                    features.coerce_number(F.col("event_type")).alias("no_number"),
                    features.coerce_timestamp(F.col("event_type")).cast("string").alias("no_time"))


def _labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    found = table(spark, sf_dir, "labels")
    return docs.join(found, "doc_id", "left").withColumn("size", F.when(F.col("quality") == 1, F.col("n_chars")))


def fill(spark, sf_dir):
    joined = _labelled(spark, sf_dir).withColumn("lang", F.when(F.col("toxic").isNull(), F.lit(None).cast("string")).otherwise(F.col("lang")))
    return features.fill_median(features.fill_constant(joined, ["lang"]), ["size", "quality"]).select("doc_id", "lang", "size", "quality")


def evaluate(spark, sf_dir):
    """Document length as a predictor of the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = docs.withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    found = features.binary_evaluation(scored, "quality", "guess", "n_chars")
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "auroc")])


def event_frame(spark, sf_dir) -> DataFrame:
    # the fitted stages hold whole parts of the frame, whose size must not grow with the table
    e = wide(spark, sf_dir, "events", task_rows=TASK_ROWS)
    raw = e.select("event_id", "user_id", "event_type", "value", features.hour("ts").alias("hour"), features.day_of_week("ts").alias("day_of_week"),
                   features.coerce_number(F.get_json_object("props", "$.k")).alias("k"), F.col("user_id").cast("string").alias("user_bucket"))
    return features.bucket_top_k(features.fill_median(raw, NUMERIC), "user_bucket")


def _flagged(spark, sf_dir):
    frame = cut_lineage(event_frame(spark, sf_dir))  # every fitted stage rereads it
    model = anomaly.fit_features(frame, NUMERIC, CATEGORICAL)
    vectors = model.transform(frame).select("event_id", "value", "hour", "event_type", "features")
    flagged = anomaly.reconstruction_flags(anomaly.isolation_flags(vectors, "event_id"), 5)
    return anomaly.weak_label(flagged), model


def anomaly_flags(spark, sf_dir):
    return _flagged(spark, sf_dir)[0].select("event_id", F.round("if_score", 6).alias("if_score"), "if_anomaly",
                                             F.round("ae_error", 6).alias("ae_error"), "ae_anomaly", "label")


def _fitted(spark, sf_dir):
    flagged, model = _flagged(spark, sf_dir)
    # the trees and the boosting rounds reread their input, so it is computed once
    flagged = cut_lineage(flagged)
    train, test = anomaly.split(flagged, "event_id")
    return anomaly.fit_classifier(train), test, model


def model_eval(spark, sf_dir):
    """Boosted trees on the weak labels against a static rule."""
    classifier, test, _ = _fitted(spark, sf_dir)
    learned = features.binary_evaluation(anomaly.predict(classifier, test), "label", "prediction", "score")
    rule = test.withColumn("rule", features.policy_violation(F.col("hour"), F.when(F.col("event_type") == "error", "TRUE").otherwise("FALSE")))
    static = features.binary_evaluation(rule, "label", "rule", "rule")
    return anomaly.comparison({"static_rules": static, "learned": learned})


def feature_importance(spark, sf_dir):
    classifier, _, model = _fitted(spark, sf_dir)
    return anomaly.feature_importance(spark, classifier, anomaly.feature_names(model, NUMERIC, CATEGORICAL))


QUERIES = {
    "feat_email_domain_topk": email_domains, "feat_host_topk": page_hosts, "feat_event_time": event_time, "feat_policy": policy,
    "feat_coerce": coerce, "feat_fill": fill, "eval_binary": evaluate, "anomaly_flags": anomaly_flags, "model_eval": model_eval,
    "feature_importance": feature_importance,
}

ORACLE = {
    "feat_email_domain_topk": r"""
        with d as (select doc_id, coalesce(nullif(regexp_extract(text, '@([\w.-]+)', 1), ''), 'unknown') as v from documents),
        k as (select v, count(*) as n from d group by 1 order by n desc, v limit 5)
        select doc_id, coalesce(k.v, 'other') as email_domain from d left join k on k.v = d.v""",
    "feat_host_topk": """
        with p as (select regexp_extract(url, '://([^/]+)', 1) as h from pages), k as (select h, count(*) as n from p group by 1 order by n desc, h limit 10)
        select coalesce(k.h, 'other') as host_bucket, count(*) as pages from p left join k on k.h = p.h group by 1""",
    "feat_event_time": """
        select cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week, count(*) as events from events group by all""",
    "feat_policy": """
        with v as (select event_id, value, case when hour(ts) in (0, 1, 2, 3) and event_type <> 'error' then 1 else 0 end as p from events)
        select event_id, p as policy_violation, (1 - p) * (1 - (value > 20)::int) as reward from v""",
    "feat_coerce": """
        select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as no_number,
               cast(try_cast(event_type as timestamp) as varchar) as no_time from events""",
    "feat_fill": """
        with j as (select d.doc_id, case when toxic is null then 'missing' else lang end as lang, case when quality = 1 then n_chars end as size, quality
                   from documents d left join labels l on l.doc_id = d.doc_id)
        select doc_id, lang, coalesce(cast(size as double), (select quantile_cont(cast(size as double), 0.5) from j)) as size,
               coalesce(cast(quality as double), (select quantile_cont(cast(quality as double), 0.5) from j)) as quality from j""",
    "eval_binary": """
        with d as (select quality as y, n_chars as s, n_chars > 1000 as g from documents join labels using (doc_id)),
        r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as k from d),
        c as (select count(*) filter (where y = 1 and g) as tp, count(*) filter (where y = 0 and g) as fp,
                count(*) filter (where y = 1 and not g) as fn, count(*) filter (where y = 0 and not g) as tn,
                count(*) filter (where y = 1) as np, count(*) filter (where y = 0) as nn, sum(k) filter (where y = 1) as w from r)
        select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
               round((w - np * (np + 1) / 2) / (np * nn), 6) as auroc from c""",
}
