"""Governed SQL: what may run, and how a statement is tidied before it runs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Tables that may be read, words that may not occur, column synonyms of the usual aliases.
TABLES = frozenset(("ubid_registry", "source_records", "activity_events", "review_queue", "audit_log"))
DENIED = ("INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "PRAGMA", "ATTACH", "DETACH", "VACUUM", "REINDEX", "REPLACE")
SYNONYMS = {"u.pincode": "u.pin_code", "sr.pincode": "sr.pin_code", "u.name": "u.business_name", "sr.department": "sr.source_system", "sr.source": "sr.source_system", "ae.date": "ae.event_date", "rq.created_at": "rq.queued_at"}
MAX_CHARS, DEFAULT_LIMIT = 2000, 100
#: Functions that a statement may call. All others (such as those that run Java or read files) are refused.
FUNCTIONS = frozenset(
    "abs add_months any_value avg bool_and bool_or bround cast ceil ceiling char_length coalesce concat concat_ws count count_if current_date current_timestamp date date_add date_diff date_format date_sub date_trunc datediff day dayofweek dense_rank"
    " exp extract first floor get_json_object greatest if ifnull initcap instr isnotnull isnull json_extract lag last lead least left length like ln log lower lpad ltrim max max_by mean median min min_by mod month months_between now ntile nullif nvl percent_rank"
    " percentile power quarter rank regexp_extract replace right round row_number rpad rtrim size split sqrt stddev strftime strpos substr substring sum to_date to_timestamp trim trunc try_cast try_to_date upper variance when year"
    .split()
)
SUBQUERIES = frozenset(("ScalarSubquery", "LateralSubquery", "ListQuery", "Exists", "FunctionTableSubqueryArgumentExpression"))
#: Nodes that a statement may not have: functions as tables, inline tables with calls, scripts, hints at files, further WITHs.
NODES_DENIED = frozenset(("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "ScriptTransformation", "InsertIntoStatement", "UnresolvedWith", "LateralJoin", "Generate", "RelationTimeTravel"))


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reason: str


def tidy(sql: str) -> str:
    """Trimmed, without closing semicolons, blanks collapsed (in literals too)."""
    return " ".join(sql.strip().rstrip(";").split())


def _nodes(plan):
    """All nodes of a parsed plan, those of subqueries and common tables too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for part in (node.children(), node.innerChildren()):
            steps = part.iterator()
            while steps.hasNext():
                todo.append(steps.next())
        found = node.expressions().iterator()
        while found.hasNext():
            yield from _expression(found.next(), todo)


def _expression(e, plans: list):
    """An expression and those in it; plans of subqueries are put on the list."""
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        if x.getClass().getSimpleName() in SUBQUERIES:
            plans.append(x.plan())
        steps = x.children().iterator()
        while steps.hasNext():
            todo.append(steps.next())


def _parts(plan) -> tuple[set[str], set[str], set[str]]:
    """Kinds of nodes, tables and functions of a plan."""
    kinds, tables, functions = set(), set(), set()
    for x in _nodes(plan):
        kind = x.getClass().getSimpleName()
        kinds.add(kind)
        if kind == "UnresolvedRelation":
            tables.add(".".join(_items(x.multipartIdentifier())).lower())
        elif kind == "UnresolvedFunction":
            functions.add(".".join(_items(x.nameParts())).lower())
    return kinds, tables, functions


def _items(sequence) -> list[str]:
    steps, out = sequence.iterator(), []
    while steps.hasNext():
        out.append(steps.next())
    return out


def _plan_fault(plan, tables: frozenset[str]) -> str | None:
    """What a parsed statement does that it may not; a common table is known to later ones and the main query only, so that
    its name hides no stored table. Further WITH clauses inside are not allowed."""
    parts, own = [], set()
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        steps = plan.cteRelations().iterator()
        while steps.hasNext():
            part = steps.next()
            parts.append((part._1().lower(), part._2()))
        plan = plan.child()
    for name, body in (*parts, (None, plan)):
        kinds, read, functions = _parts(body)
        if strange := sorted(kinds & NODES_DENIED) or sorted(k for k in kinds if k.endswith(("Command", "Statement"))):
            return f"not allowed: {strange[0]}"
        if hidden := sorted(read - tables - own):
            return f"table not allowed: {hidden[0]}"
        if unknown := sorted(functions - FUNCTIONS):
            return f"function not allowed: {unknown[0]}"
        own.add(name)
    return None


def check(spark: SparkSession, sql: str | None, tables: frozenset[str] = TABLES) -> Verdict:
    """The first rule that a statement breaks. The text's rules come first; what a statement reads and calls is taken
    from its parsed plan, against lists of what is allowed."""
    text = (sql or "").strip()
    upper = text.upper()
    found = re.search(rf"\b({'|'.join(DENIED)})\b", upper)
    faults = (
        (not text, "empty statement"), (not upper.startswith(("SELECT", "WITH")), "only SELECT or WITH may start a statement"), (not re.search(r"\bFROM\b", upper), "a statement needs FROM"), (bool(found), f"word not allowed: {found[1] if found else ''}"),
        ("--" in text or "/*" in text, "comments are not allowed"), (";" in text[:-1], "a semicolon may only end the statement"), (len(text) > MAX_CHARS, f"longer than {MAX_CHARS} characters"),
    )
    for broken, why in faults:
        if broken:
            return Verdict(False, why)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(tidy(text))
    except Exception as e:
        return Verdict(False, f"does not parse: {str(e).splitlines()[0]}")
    fault = _plan_fault(plan, tables)
    return Verdict(False, fault) if fault else Verdict(True, "OK")


def with_limit(sql: str, limit: int = DEFAULT_LIMIT) -> str:
    """A limit for statements that have none and do not count or group."""
    sql = tidy(sql)
    bounded = re.search(r"\bLIMIT\s+\d+\b|\bCOUNT\s*\(|\bGROUP\s+BY\b", sql, re.I)
    return sql if bounded else f"{sql} LIMIT {limit}"


def adapt(sql: str, industrial: tuple[str, ...]) -> str:
    """Columns by their names here; a search for factories becomes the industrial sectors; intervals and SQLite's dates
    become add_months; a maximum inside NOT EXISTS, which no engine takes, becomes "no event since"."""
    for wrong, right in SYNONYMS.items():
        sql = re.sub(rf"\b{re.escape(wrong)}\b", right, sql, flags=re.I)
    sectors = ", ".join(f"'{s}'" for s in industrial)
    sql = re.sub(r"(\w+)\.sector\s+I?LIKE\s+'%factor(?:y|ies)%'", rf"\1.sector IN ({sectors})", sql, flags=re.I)
    for since in (r"(?:NOW\(\)|CURRENT_DATE(?:\(\))?)\s*-\s*INTERVAL\s*'(\d+)\s+months?'", r"date\(\s*'now'\s*,\s*'-(\d+)\s+months?'\s*\)"):
        sql = re.sub(since, r"add_months(current_date(), -\1)", sql, flags=re.I)
    return re.sub(r"\bMAX\(\s*(\w+\.event_date)\s*\)\s*<\s*(add_months\([^()]*\(\)[^()]*\))(?=\s*\))", _since, sql, flags=re.I)


def _since(found: re.Match) -> str:
    """Inside NOT EXISTS (SELECT 1 ...) alone: elsewhere a maximum is one."""
    before = found.string[: found.start()]
    inside = re.search(r"NOT\s+EXISTS\s*\(\s*SELECT\s+1\b[^()]*$", before, re.I)
    return f"{found[1]} >= {found[2]}" if inside else found[0]


def run(spark: SparkSession, sql: str, industrial: tuple[str, ...] = ()) -> DataFrame:
    """A statement's rows; ValueError says which rule it breaks."""
    sql = adapt(sql, industrial)
    verdict = check(spark, sql)
    if not verdict.ok:
        raise ValueError(verdict.reason)
    return spark.sql(with_limit(sql))
