"""The list of registered queries and the SQL fragments their twins share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    operators: tuple[str, ...]
    build: Build
    oracle: str | None


QUERIES: dict[str, Registered] = {}


def register(name: str, operators: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; ``operators`` lists the survey ids it covers."""

    def keep(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Registered(name, tuple(operators.split()), build, oracle)
        return build

    return keep


# --- Twin fragments: the canonical tables in ANSI SQL. ---

CTES = {
    "projects": """select c_custkey as project_id, c_nationkey as user_id, c_name as name,
  lower(c_mktsegment) as framework, c_acctbal as balance from customer""",
    "users": """select n_nationkey as user_id, n_name as full_name,
  lower(n_name) || '@mail' || cast(n_regionkey as varchar) || '.example.com' as email from nation""",
    "endpoints": """select o_orderkey as endpoint_id, o_custkey as project_id,
  case o_orderstatus when 'F' then 'GET' when 'O' then 'POST' else 'DELETE' end as method,
  '/v1/' || lower(substr(o_orderpriority, 3)) || '/' || cast(o_orderkey as varchar) as path,
  o_orderpriority <> '1-URGENT' as authentication_required,
  o_orderpriority in ('2-HIGH', '5-LOW') as permission_required, o_orderdate as discovered_at from orders""",
    "findings": """select o.o_custkey as project_id, o.o_orderkey as endpoint_id,
  case o.o_orderstatus when 'F' then 'GET' when 'O' then 'POST' else 'DELETE' end as method,
  '/v1/' || lower(substr(o.o_orderpriority, 3)) || '/' || cast(o.o_orderkey as varchar) as path,
  upper(p.p_type) || '-' || lpad(substr(p.p_brand, 7), 3, '0') as rule_id, p.p_name as title,
  lower(p.p_type) || ' ' || p.p_brand as description,
  case p.p_type when 'STANDARD' then 'authentication' when 'SMALL' then 'authorization' when 'MEDIUM' then 'input_validation'
    when 'LARGE' then 'file_upload' when 'ECONOMY' then 'data_exposure' when 'PROMO' then 'business_logic' end as category,
  case when l.l_quantity >= 49 then 'critical' when l.l_quantity >= 46 then 'high' when l.l_quantity >= 38 then 'medium'
       when l.l_quantity >= 20 then 'low' else 'info' end as severity,
  case l.l_linestatus when 'F' then 'high' else 'medium' end as confidence,
  case l.l_returnflag when 'N' then 'open' when 'A' then 'accepted' else 'resolved' end as status,
  'src/s' || cast(l.l_suppkey as varchar) || '.py' as file_path, l.l_linenumber as line_number, l.l_shipdate as found_at,
  l.l_partkey, l.l_extendedprice, l.l_shipdate, l.l_tax, l.l_discount, l.l_suppkey, l.l_linenumber, l.l_quantity
from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey""",
    "rule_knowledge": """select distinct upper(p_type) || '-' || lpad(substr(p_brand, 7), 3, '0') as rule_id,
  'API' || substr(p_brand, 7) || ':2023' as owasp, 'CWE-' || substr(p_brand, 7) as cwe,
  cast(substr(p_brand, 7) as double) / 2 + 1 as cvss_score
from part where cast(substr(p_brand, 7) as int) <= 12""",
    "scan_jobs": """select o_orderkey as scan_id, o_custkey as project_id,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status,
  o_orderdate as created_at, cast(o_orderkey % 4 as int) as attempts, o_totalprice as cost, o_orderpriority as priority from orders""",
    "scan_events": """select event_id, user_id as project_id, ts,
  case event_type when 'signup' then 'queued' when 'view' then 'heartbeat' when 'click' then 'progress'
       when 'purchase' then 'completed' else 'failed' end as kind, value as progress from events""",
    "uploads": """select doc_id as upload_id, source as project_id, sha256(text) as sha256_checksum, n_chars as file_size
from documents""",
}

SEQ = "l_partkey, l_extendedprice, l_shipdate, l_tax, l_discount, l_suppkey, l_linenumber, l_quantity"
SEVERITY_RANK = ("case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 "
                 "when 'info' then 4 else 99 end")
CALCULATOR = ("case severity when 'critical' then 40 when 'high' then 25 when 'medium' then 10 when 'low' then 5 "
              "when 'info' then 1 else 0 end")
MODEL = "case severity when 'critical' then 25 when 'high' then 15 when 'medium' then 8 when 'low' then 3 else 0 end"


def band(score: str, profile: str) -> str:
    limits = {"calculator": (90, 75, 50, 25), "model": (90, 70, 50, 30)}[profile]
    a, b, c, d = limits
    return (f"case when {score} >= {a} then 'info' when {score} >= {b} then 'low' when {score} >= {c} then 'medium' "
            f"when {score} >= {d} then 'high' else 'critical' end")


def grade(score: str) -> str:
    return (f"case when {score} >= 95 then 'A+' when {score} >= 90 then 'A' when {score} >= 80 then 'B' "
            f"when {score} >= 70 then 'C' when {score} >= 60 then 'D' when {score} >= 40 then 'E' else 'F' end")


def twin(body: str, *tables: str, **extra: str) -> str:
    """A twin query with the named canonical tables, and further named subqueries, in front."""
    parts = [f"{t} as ({CTES[t]})" for t in tables] + [f"{n} as ({q})" for n, q in extra.items()]
    return ("with " + ", ".join(parts) + " " if parts else "") + body
