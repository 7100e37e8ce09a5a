"""Questions in plain words: recognised, answered from a template, relaxed when nothing matches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions import values
from regolith.operators import reports, review, views
from regolith.plans import gate
from regolith.sources.registry import INDUSTRIAL, Registry

# The words that a question is recognised by.
STATUSES = {"inactive": ("Dormant", "Closed"), "dormant": ("Dormant",), "closed": ("Closed",), "active": ("Active",)}
PAN = re.compile(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", re.I)
GSTIN = re.compile(r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b", re.I)
PIN_AFTER = re.compile(r"(?:pin\s*code|pincode|pin|postal\s*code|area\s*code)\D*(\d{6})")
MONTHS = re.compile(r"(?:last|past)\D*(\d{1,2})\D*months?")
AGGREGATE = ("how many", "count", "counts", "number of", "distribution", "summary", "most", "least", "top", "highest", "lowest", "by sector", "by area", "by pin", "by pincode", "by status", "each department", "each sector")
FACTORY = ("factory", "factories", "industrial")
INDUSTRY = (*FACTORY, "industry", "industrial unit")
AREA = ("area", "areas", "pin", "pincode", "postal", "where", "location")
SECTOR = ("business type", "business types", "sector", "sectors", "industry", "industries", "type")
GAP = ("missing", "without", "no ", "not captured", "gap")
REVIEW = ("review", "ambiguous", "human", "queue")
BANDS, BAND_SUBJECT = ("sector", "sectors", "distribution", "summary"), ("active", "dormant", "closed", "business", "ubid")
DEPARTMENT, DEPARTMENT_COUNT = ("department", "source system", "source systems", "source records"), ("most", "count", "counts", "summary", "how many", "distribution")
DEFAULT_PIN, DEFAULT_MONTHS = "560058", 18
MOST, REPAIRS = 50, 3


@dataclass(frozen=True)
class Question:
    """What a question mentions."""

    text: str
    lower: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "lower", self.text.lower())

    def has(self, words: tuple[str, ...]) -> bool:
        return any(w in self.lower for w in words)

    @property
    def statuses(self) -> tuple[str, ...] | None:
        if re.search(r"\bnot\s+active\b", self.lower):
            return STATUSES["inactive"]
        return next((v for w, v in STATUSES.items() if re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9])", self.lower)), None)

    @property
    def pin(self) -> str | None:
        found = PIN_AFTER.search(self.lower) or re.search(r"\b(\d{6})\b", self.lower)
        return found[1] if found else None

    @property
    def months(self) -> int:
        found = MONTHS.search(self.lower)
        return int(found[1]) if found else DEFAULT_MONTHS

    @property
    def aggregate(self) -> bool:
        return self.has(AGGREGATE)

    def identifier(self, pattern: re.Pattern) -> str | None:
        found = pattern.search(self.text)
        return found[0].upper() if found else None


@dataclass(frozen=True)
class Template:
    tag: str
    fits: Callable[[Question], object]
    rows: Callable[[Registry, Question, str], DataFrame]


def _summary(r: Registry, q: Question, key: str, industrial: bool = False) -> DataFrame:
    u = views.ubid_registry(r).filter(F.col("status").isin(*q.statuses) & F.col(key).isNotNull())
    u = u.filter(F.col("sector").isin(*INDUSTRIAL)) if industrial else u
    out = u.groupBy(key).agg(F.count(F.lit(1)).alias("business_count"), F.round(F.avg("confidence_score"), 3).alias("average_match_confidence"))
    return out.orderBy(F.desc("business_count"), key).limit(MOST)


def _listed(r: Registry, q: Question) -> DataFrame:
    where = F.col("status").isin(*q.statuses)
    where = where & (F.col("pin_code") == q.pin) if q.pin else where
    where = where & F.col("sector").isin(*INDUSTRIAL) if q.has(FACTORY) else where
    return reports.business_list(views.ubid_registry(r), where, [F.desc_nulls_last("confidence_score"), F.asc_nulls_first("business_name")], MOST)


def _stale(r: Registry, q: Question, today: str) -> DataFrame:
    cutoff = r.spark.range(1).select(F.add_months(F.lit(today).cast("date"), -q.months).cast("string")).first()[0]
    return reports.q3_stale_inspections(r, cutoff, q.statuses, q.pin or DEFAULT_PIN).orderBy("business_name", "ubid").limit(MOST)


def _bands(r: Registry) -> DataFrame:
    return views.ubid_registry(r).groupBy("sector", "status").agg(F.count(F.lit(1)).alias("ubid_count")).orderBy(F.desc("ubid_count"), "sector", "status").limit(MOST)


#: In the order in which they are tried.
TEMPLATES = (
    Template("pan-lookup", lambda q: q.identifier(PAN), lambda r, q, _: reports.q1_pan(r, q.identifier(PAN))),
    Template("gstin-lookup", lambda q: q.identifier(GSTIN), lambda r, q, _: reports.q2_gstin(r, q.identifier(GSTIN))),
    Template("factory-inspection", lambda q: q.statuses and "inspection" in q.lower and q.has(FACTORY), _stale),
    Template("identifier-gap", lambda q: "pan" in q.lower and "gstin" in q.lower and q.has(GAP), lambda r, q, _: reports.q4_pan_without_gstin(r).orderBy("business_name", "ubid").limit(MOST)),
    Template("review-queue", lambda q: q.has(REVIEW), lambda r, q, _: review.open_items(r.review_queue(), MOST)),
    Template("status-by-area", lambda q: q.statuses and q.has(AREA) and q.aggregate, lambda r, q, _: _summary(r, q, "pin_code", q.has(INDUSTRY))),
    Template("status-by-sector", lambda q: q.statuses and q.has(SECTOR) and q.aggregate, lambda r, q, _: _summary(r, q, "sector")),
    Template("sector-bands", lambda q: q.aggregate and q.has(BANDS) and q.has(BAND_SUBJECT), lambda r, q, _: _bands(r)),
    Template("department-records", lambda q: q.has(DEPARTMENT) and q.has(DEPARTMENT_COUNT), lambda r, q, _: reports.q9_departments(r).orderBy(F.desc("records"), "source_system").limit(MOST)),
    Template("status-list", lambda q: q.statuses and not q.aggregate, lambda r, q, _: _listed(r, q)),
)


def match(text: str) -> Template | None:
    q = Question(text)
    return next((t for t in TEMPLATES if t.fits(q)), None)


def hints(r: Registry, n: int = 20) -> DataFrame:
    """(column, value): up to n values of the columns that questions filter by."""
    wanted = ((views.ubid_registry(r), "status"), (views.ubid_registry(r), "sector"), (views.source_records(r), "source_system"), (views.activity_events(r), "event_type"), (r.review_queue(), "status"))
    out = None
    for k, (df, c) in enumerate(wanted):
        name = "review_status" if k == 4 else c
        part = df.filter(F.coalesce(F.col(c), F.lit("")) != "").select(F.lit(name).alias("column"), F.col(c).alias("value")).distinct().orderBy("value").limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def relax(r: Registry, text: str) -> dict:
    """When a question finds nothing: what its filters match alone, and rows nearby."""
    q, u = Question(text), views.ubid_registry(r)
    where = F.lit(True)
    where = where & F.col("status").isin(*q.statuses) if q.statuses else where
    where = where & F.col("sector").isin(*INDUSTRIAL) if q.has(INDUSTRY) else where
    asked = bool(q.statuses or q.has(INDUSTRY))
    at_pin = F.coalesce(F.col("pin_code") == q.pin, F.lit(False)) if q.pin else F.lit(False)
    n = u.agg(F.count_if(at_pin).alias("pin"), F.count_if(where).alias("filters")).first()
    facts = []
    if q.pin:
        facts.append(f"PIN code {q.pin} has {n['pin']} businesses before other filters." if n["pin"] else f"PIN code {q.pin} does not occur in the data.")
    if asked:
        facts.append(f"The status and business type asked for match {n['filters']} businesses in all PIN codes.")
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s.lower()}_count")
    order = [F.asc_nulls_first(c) for c in ("status", "sector", "business_name")]
    tries = (
        (q.pin and asked, f"Businesses in PIN {q.pin}", lambda: reports.business_list(u, at_pin, order, 25)),
        (asked, "PIN codes with matching businesses", lambda: u.filter(where & F.col("pin_code").isNotNull()).groupBy("pin_code").agg(F.count(F.lit(1)).alias("business_count"), count("Active"), count("Dormant"), count("Closed")).orderBy(F.desc("business_count"), "pin_code").limit(25)),
        (q.pin, "Some businesses", lambda: reports.business_list(u, F.lit(True), [F.asc_nulls_first("pin_code"), F.asc_nulls_first("business_name")], 25)),
    )
    for wanted, title, rows in tries:
        found = [x.asDict() for x in rows().collect()] if wanted else []  # 25 rows at most
        if found:
            return {"mode": "no_exact_match_with_related", "title": title, "related": found, "facts": facts}
    return {"mode": "no_exact_match", "title": None, "related": [], "facts": facts}


def modes(rows: DataFrame, columns: tuple[str, ...] = ("pin_code", "sector", "status"), top: int = 3) -> DataFrame:
    """(column, value, n): the most frequent non-empty values of each column."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    n = rows.select(F.explode(entries).alias("e")).select("e.*").filter("value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return n.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def shown(rows: DataFrame) -> DataFrame:
    """A result as its table shows it: friendly headings, cells as text."""
    return rows.select(*[values.display(F.col(c), kind).alias(c.replace("_", " ").title()) for c, kind in rows.dtypes])


def report(rows: list[dict]) -> str:
    """A sentence about at most 50 rows, by their columns."""
    if not rows:
        return "Nothing matches the question."
    top, n = rows[0], len(rows)
    if "priority" in top:
        mean = sum(x["confidence"] or 0 for x in rows) / n
        return f"{n} pairs wait for a reviewer, with a mean confidence of {mean:.2f}. Those of the highest priority come first."
    if "ubid_count" in top:
        return f"{n} groups of sector and status; the largest is {top['sector']} / {top['status']} with {top['ubid_count']} businesses."
    if "source_system" in top and "records" in top:
        return f"{n} departments; {top['source_system']} has the most records, {top['records']}."
    for key, name in (("pin_code", "PIN codes"), ("sector", "sectors")):
        if "business_count" in top and key in top:
            return f"{n} {name}; {top[key]} leads with {top['business_count']} businesses."
    if "last_inspection" in top:
        return f"{n} industrial businesses have no recent inspection; {sum(x['last_inspection'] is None for x in rows)} of them have none at all."
    usual = [", ".join(f"{v} ({k})" for v, k in Counter(x[c] for x in rows if x.get(c)).most_common(3)) for c in ("pin_code", "sector", "status")]
    most = "".join(f" Most by {name}: {text}." for name, text in zip(("PIN code", "sector", "status"), usual) if text)
    return f"{n} businesses match; the first is {top.get('business_name')}.{most}"


class Engine:
    """Answers questions over a registry. `to_sql` may turn other questions into SQL: (question, last error) -> SQL."""

    def __init__(self, registry: Registry, today: str, to_sql: Callable[[str, str | None], str] | None = None):
        self.r, self.today, self.to_sql = registry, today, to_sql

    def rows(self, text: str) -> tuple[str, DataFrame]:
        t = match(text)
        if t:
            return t.tag, t.rows(self.r, Question(text), self.today)
        if self.to_sql is None:
            raise ValueError("no template fits the question, and none writes SQL")
        if re.search("[A-Z]{5}[0-9]{4}[A-Z]", text):
            raise ValueError("tax numbers are not handed on")
        views.create_views(self.r)
        error = None
        for _ in range(REPAIRS):
            try:
                return "written-sql", gate.run(self.r.spark, self.to_sql(text, error), INDUSTRIAL)
            except Exception as e:
                error = str(e)
        raise ValueError(f"no valid statement after {REPAIRS} attempts: {error}")

    def ask(self, text: str) -> dict:
        tag, df = self.rows(text)
        rows = [x.asDict() for x in df.limit(gate.DEFAULT_LIMIT).collect()]  # a bounded page for display
        answer = {"tag": tag, "results": rows, "row_count": len(rows), "mode": "exact", "report": report(rows)}
        return answer if rows else answer | relax(self.r, text)
