"""The supplied star-schema tables read as companies, roles, openings, signals and so on.

company = nation, role = customer, role family = market segment, opening = order,
date precision = order status, source quality = order priority, signal and
attempt log = event. Every derived value is a function of the row, so each query
over these tables has an exact SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import load


def companies(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company"), F.col("n_regionkey").alias("region_id"))


def roles(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("role_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("company_id"), F.col("c_mktsegment").alias("family"),
        F.element_at(F.array(*map(F.lit, ("internship", "new_grad", "apprenticeship", "unknown"))), F.pmod("c_custkey", F.lit(4)).cast("int") + 1).alias("level"),
        F.element_at(F.array(*map(F.lit, ("summer", "fall", "unknown"))), F.pmod("c_custkey", F.lit(3)).cast("int") + 1).alias("season"),
        F.col("c_acctbal").alias("balance"),
    )


def openings(spark: SparkSession, d: str) -> DataFrame:
    """One opening for each order: date, precision, quality, uncertainty, availability, cohort key."""
    o = load(spark, d, "orders")
    on = F.to_date("o_orderdate")
    precision = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "bounded").otherwise("observed_by")
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("role_id"), on.alias("opened_on"), precision.alias("precision"),
        ((F.lit(11) - F.substring("o_orderpriority", 1, 1).cast("int")) / 10.0).alias("quality"),
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 30.0).alias("uncertainty"),
        ((F.pmod("o_orderkey", F.lit(5)) + 6) / 10.0).alias("match"),
        F.date_add(on, F.pmod("o_orderkey", F.lit(40)).cast("int")).alias("available_on"),
        F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.concat(F.lit("annual-"), F.year(on).cast("string"))).alias("cycle_key"),
    )


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("role_id"), F.date_sub(F.to_date("ts"), 9510).alias("observed_on"), F.col("event_type").alias("kind"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, "contradict").otherwise("support").alias("direction"),
        ((F.pmod("event_id", F.lit(9)) + 1) / 10.0).alias("strength"), ((F.pmod("event_id", F.lit(4)) + 6) / 10.0).alias("reliability"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("evidence_id"),
    )


#: The same readings in DuckDB SQL, for the oracle queries.
SQL = {
    "companies": "select n_nationkey as company_id, n_name as company, n_regionkey as region_id from nation",
    "roles": """select c_custkey as role_id, c_name as title, c_nationkey as company_id, c_mktsegment as family,
        ['internship','new_grad','apprenticeship','unknown'][(c_custkey % 4)::int + 1] as level,
        ['summer','fall','unknown'][(c_custkey % 3)::int + 1] as season, c_acctbal as balance from customer""",
    "openings": """select o_orderkey as event_id, o_custkey as role_id, o_orderdate::date as opened_on,
        case o_orderstatus when 'F' then 'exact' when 'O' then 'bounded' else 'observed_by' end as precision,
        (11 - left(o_orderpriority, 1)::int) / 10.0::double as quality,
        case o_orderstatus when 'F' then 0.0::double when 'O' then 30.0::double end as uncertainty,
        ((o_orderkey % 5) + 6) / 10.0::double as match,
        (o_orderdate::date + (o_orderkey % 40)::int) as available_on,
        case when o_orderkey % 7 = 0 then 'annual-' || year(o_orderdate) end as cycle_key from orders""",
    "signals": """select event_id as signal_id, user_id as role_id, (ts::date - 9510) as observed_on, event_type as kind,
        case when event_id % 5 = 0 then 'contradict' else 'support' end as direction,
        ((event_id % 9) + 1) / 10.0::double as strength, ((event_id % 4) + 6) / 10.0::double as reliability,
        case when event_id % 3 <> 0 then 'e' || event_id::varchar end as evidence_id from events""",
}


def with_sql(names: str, body: str) -> str:
    """``with companies as (...), ...`` for the named readings, then ``body``."""
    return "with recursive " + ",\n".join(f"{n} as ({SQL[n]})" for n in names.split()) + "\n" + body.strip()
