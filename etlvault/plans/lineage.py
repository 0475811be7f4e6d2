"""Concept alignment of entities, and lineage tables from a mapping catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword → (ontology class, domain, module), tried in this order.
ONTOLOGY_CONCEPTS = {
    "CUSTOMER": ("fibo-be-le-lp:LegalPerson", "BusinessEntities", "BE"),
    "PARTY": ("fibo-fnd-pty-pty:Party", "Foundations", "FND"),
    "ORGANIZATION": ("fibo-fnd-org-org:Organization", "Foundations", "FND"),
    "ACCOUNT": ("fibo-fbc-pas-caa:Account", "FinancialBusinessAndCommerce", "FBC"),
    "PRODUCT": ("fibo-fbc-pas-fpas:FinancialProduct", "FinancialBusinessAndCommerce", "FBC"),
    "ORDER": ("fibo-fbc-pas-fpas:ContractualProduct", "FinancialBusinessAndCommerce", "FBC"),
    "CONTRACT": ("fibo-fnd-agr-ctr:Contract", "Foundations", "FND"),
    "TRANSACTION": ("fibo-fbc-pas-caa:AccountTransaction", "FinancialBusinessAndCommerce", "FBC"),
    "PAYMENT": ("fibo-fbc-pas-caa:Payment", "FinancialBusinessAndCommerce", "FBC"),
    "LOAN": ("fibo-loan-ln-ln:Loan", "Loans", "LOAN"),
    "SECURITY": ("fibo-sec-sec-lst:Security", "Securities", "SEC"),
    "INSTRUMENT": ("fibo-fbc-fi-fi:FinancialInstrument", "FinancialBusinessAndCommerce", "FBC"),
    "PRICE": ("fibo-fbc-fi-ip:InstrumentPrice", "Securities", "SEC"),
    "CURRENCY": ("fibo-fnd-acc-cur:Currency", "Foundations", "FND"),
    "ADDRESS": ("fibo-fnd-plc-adr:Address", "Foundations", "FND"),
    "IDENTIFIER": ("fibo-fnd-rel-rel:hasIdentifier", "Foundations", "FND"),
    "DATE": ("fibo-fnd-dt-fd:Date", "Foundations", "FND"),
    "AMOUNT": ("fibo-fnd-acc-cur:MonetaryAmount", "Foundations", "FND"),
}
# Keyword → (service domain, business area, version), tried in this order.
SERVICE_DOMAINS = {
    "CUSTOMER": ("Customer Relationship Management", "Sales & Service", "v13"),
    "ACCOUNT": ("Current Account", "Operations & Execution", "v13"),
    "PRODUCT": ("Product Directory", "Products", "v13"),
    "ORDER": ("Sales Order", "Sales & Service", "v13"),
    "PAYMENT": ("Payment Execution", "Operations & Execution", "v13"),
    "LOAN": ("Consumer Loan", "Products", "v13"),
    "TRANSACTION": ("Financial Accounting", "Business Support", "v13"),
    "PARTY": ("Party Reference Data Management", "Business Support", "v13"),
    "RISK": ("Credit Risk Operations", "Risk & Compliance", "v13"),
    "CONTRACT": ("Customer Agreement", "Sales & Service", "v13"),
    "INSTRUMENT": ("Investment Portfolio Management", "Products", "v13"),
    "SECURITY": ("Securities Position Keeping", "Operations & Execution", "v13"),
    "PRICE": ("Market Data Switch Operation", "Operations & Execution", "v13"),
    "EMPLOYEE": ("Human Resources", "Business Support", "v13"),
}
NO_ONTOLOGY = ("No FIBO match", "—", "—")
NO_DOMAIN = ("No BIAN match", "—", "—")


def match_concept(name: Column, concepts: Mapping[str, Sequence[str]], default: Sequence[str], fields: Sequence[str]) -> Column:
    """Struct of the first concept whose keyword the name contains. A fixed CASE, so no join is needed."""
    def entry(values: Sequence[str], keyword: str | None) -> Column:
        return F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, values)], F.lit(keyword).alias("matched_keyword"))

    text, picked = F.upper(name), F
    for keyword, values in concepts.items():
        picked = picked.when(text.contains(keyword), entry(values, keyword))
    return picked.otherwise(entry(default, None))


def align(entities: DataFrame, name: str) -> DataFrame:
    """Ontology class and service domain of every entity name."""
    ontology = match_concept(F.col(name), ONTOLOGY_CONCEPTS, NO_ONTOLOGY, ("concept_class", "concept_domain", "concept_module"))
    service = match_concept(F.col(name), SERVICE_DOMAINS, NO_DOMAIN, ("service_domain", "business_area", "service_version"))
    found = entities.withColumn("__o", ontology).withColumn("__s", service)
    return found.select(*entities.columns, "__o.concept_class", "__o.concept_domain", "__o.concept_module",
                        "__s.service_domain", "__s.business_area", "__s.service_version")


def edges(mappings: DataFrame) -> DataFrame:
    """Column-level lineage."""
    return mappings.select(F.col("source_table").alias("from_table"), F.col("source_column").alias("from_column"),
                           F.col("target_table").alias("to_table"), F.col("target_column").alias("to_column"), "expression")


def table_edges(mappings: DataFrame) -> DataFrame:
    """Edges per pair of tables."""
    return mappings.groupBy(F.col("source_table").alias("from_table"), F.col("target_table").alias("to_table")).agg(
        F.count("*").alias("column_edges"))


def nodes(catalog: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Tables with their ordered columns, and views."""
    distinct = catalog.groupBy("table_name", "column_name").agg(F.min("schema_name").alias("s"), F.min("ordinal").alias("o"))
    tables = distinct.groupBy(F.col("table_name").alias("id")).agg(
        F.lit("table").alias("type"), F.min("s").alias("schema_name"),
        F.transform(F.sort_array(F.collect_list(F.struct("o", "column_name"))), lambda e: e["column_name"]).alias("columns"))
    if views is None:
        return tables
    return tables.unionByName(views.select(F.col("name").alias("id"), F.lit("view").alias("type"), "schema_name",
                                           F.array().cast("array<string>").alias("columns")))
