"""Code graphs as rows: JSON ingest and node look-up (source 8; projections 9 and 10; compositions X12, X13, X18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a graph document.
GRAPH = (
    "scan_id string, timestamp bigint, language string, tool string, version string, "
    "nodes array<struct<id:bigint,type:string,name:string,dataType:string,returnType:string,parameters:int,arguments:int,scope:string,className:string,initializer:string,expression:string,operator:string,"
    "target:string,value:string,length:int,field:string,condition:string,hasElse:boolean,variable:string,iterable:string,catchClausesCount:int,hasFinallyBlock:boolean,exceptionTypes:array<string>>>, "
    "edges array<struct<source:bigint,target:bigint,type:string>>, statistics map<string,bigint>"
)
# Function names that bring input in, hand it on, are unsafe, or manage memory.
TAINT_SOURCES = ["scanf", "fscanf", "gets", "fgets", "getline", "read", "recv", "recvfrom", "getenv", "gethostbyname", "accept", "cin"]
TAINT_SINKS = ["system", "exec", "execl", "execv", "popen", "fopen", "send", "sendto", "strcpy", "strcat", "sprintf", "vsprintf", "mysql_query", "sqlite3_exec"]
DANGEROUS = ["gets", "strcpy", "strcat", "sprintf", "vsprintf", "strncpy", "strncat"]
MEMORY = ["malloc", "calloc", "realloc", "free", "new", "delete"]
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]


def parse(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Graph documents with their structure; what is no JSON has null fields."""
    return docs.select(F.from_json(payload, GRAPH).alias("g")).select("g.*")


def nodes(graphs: DataFrame) -> DataFrame:
    """(scan_id, pos, all node fields) of parsed graphs, in document order."""
    return graphs.select("scan_id", F.posexplode("nodes").alias("pos", "n")).select("scan_id", "pos", "n.*")


def edges(graphs: DataFrame) -> DataFrame:
    """(scan_id, pos, source, target, type) of parsed graphs."""
    return graphs.select("scan_id", F.posexplode("edges").alias("pos", "e")).select("scan_id", "pos", "e.*")


def last_by_id(nodes: DataFrame) -> DataFrame:
    """One node per identifier, the last in document order (X13). A struct maximum, combined before the shuffle."""
    rest = [c for c in nodes.columns if c not in ("scan_id", "id", "pos")]
    return nodes.groupBy("scan_id", "id").agg(F.max(F.struct("pos", *rest)).alias("n")).select("scan_id", "id", "n.pos", *(f"n.{c}" for c in rest))


def ids_by_name(nodes: DataFrame, types: tuple[str, ...] = ("METHOD", "CONSTRUCTOR")) -> DataFrame:
    """(scan_id, name, ids) of definitions."""
    return nodes.filter(F.col("type").isin(*types) & F.col("name").isNotNull()).groupBy("scan_id", "name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def call_flags(name: Column) -> dict[str, Column]:
    """What a called function's name says about it (projection 9)."""
    has = lambda xs: F.coalesce(name.isin(xs), F.lit(False))
    return {"taint_source": has(TAINT_SOURCES), "taint_sink": has(TAINT_SINKS), "dangerous": has(DANGEROUS), "vulnerability": F.when(has(DANGEROUS), F.lit("BUFFER_OVERFLOW_RISK")), "memory_operation": has(MEMORY)}


def sql_literal(value: Column) -> Column:
    """Does a text hold one of the statement words, in capitals (projection 10)?"""
    hit = F.lit(False)
    for word in SQL_WORDS:
        hit = hit | F.contains(value, F.lit(word))
    return F.coalesce(hit, F.lit(False))
