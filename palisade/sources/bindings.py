"""The driver's star-schema tables seen as the engine's canonical tables.

Roles: nation = user, customer = project, order = endpoint and scan job, lineitem = finding, part = rule,
document = source file and upload, event = lifecycle event. Each binding reads only the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.session import prepare, shuffles_deleted

# Product rule types mapped to finding categories (a fixed choice of this binding).
CATEGORY_OF_TYPE = {
    "STANDARD": "authentication",
    "SMALL": "authorization",
    "MEDIUM": "input_validation",
    "LARGE": "file_upload",
    "ECONOMY": "data_exposure",
    "PROMO": "business_logic",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.col("c_nationkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.lower("c_mktsegment").alias("framework"),
        F.col("c_acctbal").alias("balance"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("user_id"),
        F.col("n_name").alias("full_name"),
        F.concat(F.lower("n_name"), F.lit("@mail"), F.col("n_regionkey").cast("string"), F.lit(".example.com")).alias("email"),
    )


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("endpoint_id"),
        F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_orderstatus") == "F", "GET").when(F.col("o_orderstatus") == "O", "POST").otherwise("DELETE").alias("method"),
        F.concat(F.lit("/v1/"), F.lower(F.substring(priority, 3, 100)), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
        (priority != "1-URGENT").alias("authentication_required"),
        priority.isin("2-HIGH", "5-LOW").alias("permission_required"),
        F.col("o_orderdate").alias("discovered_at"),
    )


def _severity(quantity: Column) -> Column:
    return (
        F.when(quantity >= 49, "critical")
        .when(quantity >= 46, "high")
        .when(quantity >= 38, "medium")
        .when(quantity >= 20, "low")
        .otherwise("info")
    )


def _category(kind: Column) -> Column:
    chain = F.when(kind == "STANDARD", CATEGORY_OF_TYPE["STANDARD"])
    for name, category in list(CATEGORY_OF_TYPE.items())[1:]:
        chain = chain.when(kind == name, category)
    return chain


def _rule_id(kind: Column, brand: Column) -> Column:
    return F.concat(F.upper(kind), F.lit("-"), F.lpad(F.substring(brand, 7, 10), 3, "0"))


def endpoint_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings reduced to what scoring needs. No join: the endpoint and severity sit in one table."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("endpoint_id"),
        _severity(F.col("l_quantity")).alias("severity"),
        F.when(F.col("l_linestatus") == "F", "high").otherwise("medium").alias("confidence"),
        F.when(F.col("l_returnflag") == "N", "open").when(F.col("l_returnflag") == "A", "accepted").otherwise("resolved").alias("status"),
    )


def project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their project but nothing of their rule: one join fewer than ``findings``, for counts and scores."""
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("endpoint_id"), F.col("o_custkey").alias("project_id"))
    return endpoint_severities(spark, sf_dir).join(order, "endpoint_id").select("project_id", "endpoint_id", "severity", "confidence", "status")


FINDINGS_PER_TASK = 250_000


def finding_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks findings go for each to hold ``FINDINGS_PER_TASK`` on average; their number comes from the footers of the files."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // FINDINGS_PER_TASK))


FINDINGS_PER_PIECE = 4_000_000
MOST_PIECES = 8


def finding_pieces(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The pieces, by endpoint, that findings are worked through in, one after the other. Each reads the tables once more, so their number has a bound."""
    with shuffles_deleted(spark):
        pieces = min(MOST_PIECES, max(1, -(-table(spark, sf_dir, "lineitem").count() // FINDINGS_PER_PIECE)))
    return [(i, pieces) for i in range(pieces)]


def _of_piece(line: DataFrame, piece: tuple[int, int] | None) -> DataFrame:
    # Another hash than the one that shuffles, which would leave most tasks of a piece without rows.
    return line.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(piece[1])) == piece[0]) if piece and piece[1] > 1 else line


def crowded_endpoints(spark: SparkSession, sf_dir: str, piece: tuple[int, int] | None = None) -> list[int]:
    """Endpoints that have more findings than a task should hold, one at most for every ``FINDINGS_PER_TASK`` findings; mostly there is none."""
    line = table(spark, sf_dir, "lineitem")
    sizes = _of_piece(line, piece).filter("l_orderkey is not null").groupBy("l_orderkey").count()
    with shuffles_deleted(spark):
        return [r[0] for r in sizes.filter(F.col("count") > FINDINGS_PER_TASK).collect()] if line.count() > FINDINGS_PER_TASK else []


def findings(spark: SparkSession, sf_dir: str, tasks: int | None = None, piece: tuple[int, int] | None = None) -> DataFrame:
    """Findings with project and rule columns. ``seq`` is the explicit order of every first-wins operator.

    The joins have the session's number of partitions, or ``tasks``; with these the rows of an endpoint are in one partition. ``piece`` is one
    of ``finding_pieces``: the findings of its endpoints.
    """
    cut = lambda frame, key: frame.repartition(tasks, key) if tasks else frame
    line = _of_piece(table(spark, sf_dir, "lineitem"), piece).withColumnRenamed("l_orderkey", "endpoint_id")
    order = endpoints(spark, sf_dir).select("endpoint_id", "project_id", "method", "path")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        _rule_id(F.col("p_type"), F.col("p_brand")).alias("rule_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", F.lower("p_type"), F.col("p_brand")).alias("description"),
        _category(F.col("p_type")).alias("category"),
    )
    # Orders last: the rows stay together by endpoint, for whoever groups by it.
    return (
        cut(cut(line, "l_partkey").join(cut(part, "l_partkey"), "l_partkey"), "endpoint_id")
        .join(cut(order, "endpoint_id"), "endpoint_id")
        .select(
            "project_id",
            "endpoint_id",
            "method",
            "path",
            "rule_id",
            "title",
            "description",
            "category",
            _severity(F.col("l_quantity")).alias("severity"),
            F.when(F.col("l_linestatus") == "F", "high").otherwise("medium").alias("confidence"),
            F.when(F.col("l_returnflag") == "N", "open").when(F.col("l_returnflag") == "A", "accepted").otherwise("resolved").alias("status"),
            F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_path"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_shipdate").alias("found_at"),
            F.struct("l_partkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount", "l_suppkey", "l_linenumber", "l_quantity").alias("seq"),
        )
    )


def rule_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge for about half of the rules, so coverage is not trivial."""
    number = F.substring("p_brand", 7, 10)
    return (
        table(spark, sf_dir, "part")
        .filter(number.cast("int") <= 12)
        .select(
            _rule_id(F.col("p_type"), F.col("p_brand")).alias("rule_id"),
            F.concat(F.lit("API"), number, F.lit(":2023")).alias("owasp"),
            F.concat(F.lit("CWE-"), number).alias("cwe"),
            (number.cast("double") / 2 + 1).alias("cvss_score"),
        )
        .distinct()
    )


def scan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("project_id"),
        F.when(status == "F", "completed").when(status == "O", "queued").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
        F.col("o_totalprice").alias("cost"),
        F.col("o_orderpriority").alias("priority"),
    )


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events; the zone-less event time becomes a timestamp so that it can carry a watermark."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("project_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "queued").when(kind == "view", "heartbeat").when(kind == "click", "progress")
        .when(kind == "purchase", "completed").otherwise("failed").alias("kind"),
        F.col("value").alias("progress"),
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("project_id"),
        F.concat_ws("/", "source", "lang", F.concat(doc, F.lit(".py"))).alias("relative_path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("size_bytes"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("upload_id"),
        F.col("source").alias("project_id"),
        F.sha2(F.col("text"), 256).alias("sha256_checksum"),
        F.col("n_chars").alias("file_size"),
    )
