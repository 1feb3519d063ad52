"""Loading labelled cases: case.json beside a folder of marked documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators.evaluate import strip_markup


def load_cases(spark: SparkSession, root: str, tier: str | None = None, split: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, documents, facts) of root/<case>/case.json and root/<case>/corpus/**.

    Facts are marked in the documents; case.json says which must and must not be sent, and why not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_extract("path", r"([^/]+)/(?:case\.json|corpus/)", 1)
    inner = F.regexp_extract("path", r"/corpus/(.*)$", 1)
    text = F.col("content").cast("string")
    each = files.select(at.alias("case_id"), inner.alias("document"), F.col("path").endswith("/case.json").alias("is_case"), text.alias("text")).where("case_id <> ''")
    spec = "question string, language string, genre string, tier string, split string, origin string, budget string, must_include array<string>, must_not_include array<string>, traps map<string,struct<kind:string,expect_omission_rule:string>>"
    cases = each.where("is_case").select("case_id", F.from_json("text", spec).alias("c")).select("case_id", "c.*")
    for name, value in (("tier", tier), ("split", split)):
        if value is not None:
            cases = cases.where(F.col(name) == value)

    @F.pandas_udf("string")
    def stripped(texts):
        return texts.map(lambda t: json.dumps(dict(zip(("text", "facts"), strip_markup(t)))))

    shape = "text string, facts map<string,array<int>>"
    marked = each.where("document <> ''").withColumn("m", F.from_json(stripped("text"), shape)).join(cases.select("case_id"), "case_id", "left_semi")
    documents = marked.select("case_id", F.col("document").alias("source_path"), F.col("m.text").alias("content"))
    f = marked.select("case_id", "document", F.col("m.text").alias("content"), F.explode("m.facts").alias("fact_id", "span"))
    f = f.select("case_id", "document", "fact_id", F.col("span")[0].alias("start"), F.col("span")[1].alias("end"), F.substr("content", F.col("span")[0] + 1, F.col("span")[1] - F.col("span")[0]).alias("text"))
    facts = f.join(cases.select("case_id", "must_include", "must_not_include", "traps"), "case_id").select(
        *f.columns, F.array_contains("must_include", F.col("fact_id")).alias("must_include"), F.array_contains("must_not_include", F.col("fact_id")).alias("must_not_include"), F.element_at("traps", F.col("fact_id"))["expect_omission_rule"].alias("expected_rule")
    )
    return cases, documents, facts
