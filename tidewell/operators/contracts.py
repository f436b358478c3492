"""What surrounds a language model: prompts, parsing, sanitising, conversations, injected clients. No network here."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What is redacted in queries.
REDACTED = (("[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("[PHONE]", r"\+?\d[\d ().-]{7,}\d"))
LIMITS = {"query": 500, "context": 100_000, "message": 10_000}
PROMPTS = {
    "expand": "You help visitors of {SITE_NAME} ({SITE_DESCRIPTION}) to search. Name related search terms as a JSON array of short strings.",
    "summarize": "Answer from the given pages of {SITE_NAME} only, in a few sentences, and name the pages.",
    "follow_up": "Go on with this conversation about pages of {SITE_NAME}.",
}


def sanitize_query(query: Column, custom: tuple[tuple[str, str], ...] = ()) -> Column:
    """E-mail addresses, phone numbers and own patterns are replaced by their names."""
    for name, pattern in (*REDACTED, *custom):
        query = F.regexp_replace(query, pattern, name)
    return query


def truncate_conversations(turns: DataFrame, max_length: int = 12_000, keep_first: int = 2, unit: int = 2, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Turns that fit: the first ``keep_first`` always, then the latest ones in units from the end.

    Units are removed oldest first until the rest is at most ``max_length`` characters.
    """
    own = Window.partitionBy(conv)
    rows = turns.withColumns({"_n": F.row_number().over(own.orderBy(turn)) - 1, "_len": F.length(F.coalesce(F.col(text), F.lit("")))})
    rows = rows.withColumn("_head", F.sum(F.when(F.col("_n") < keep_first, F.col("_len")).otherwise(0)).over(own))
    rows = rows.withColumn("_unit", F.when(F.col("_n") >= keep_first, F.floor((F.col("_n") - keep_first) / unit)))
    later = own.orderBy(F.desc("_unit")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_tail", F.sum(F.when(F.col("_n") >= keep_first, F.col("_len")).otherwise(0)).over(later))
    return rows.where((F.col("_n") < keep_first) | (F.col("_head") + F.col("_tail") <= max_length)).select(*turns.columns)


def follow_up_status(turns: DataFrame, max_follow_ups: int = 3, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages, follow_ups, status): 400 for a wrong message or last role, 429 beyond the limit, else 200."""
    message = F.struct(turn, role, text)
    good = F.col(role).isin("user", "assistant") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & (F.length(text) <= LIMITS["message"])
    rows = turns.groupBy(conv).agg(F.count(F.lit(1)).alias("messages"), F.bool_and(good).alias("good"), F.max(message)[role].alias("last"))
    follow_ups = F.when(F.col("messages") < 2, 0).otherwise(F.floor((F.col("messages") - 2) / 2)).cast("int")
    status = F.when(~F.col("good") | (F.col("last") != "user"), 400).when(follow_ups >= max_follow_ups, 429).otherwise(200)
    return rows.select(conv, "messages", follow_ups.alias("follow_ups"), status.alias("status"))


def strip_fences(response: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(response), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def expansion_terms(response: Column, query: Column, generic: tuple[str, ...] = (), existing: Column | None = None) -> Column:
    """Terms of a response (an object with terms, or an array), the query alone if there are fewer than two."""
    body = strip_fences(response)
    listed = F.coalesce(F.when(body.startswith("["), F.from_json(body, "array<string>")), F.when(body.startswith("{"), F.from_json(body, "terms array<string>")["terms"]))
    terms = F.when(F.size(listed) >= 2, listed).otherwise(F.array(query))
    if generic:
        terms = F.filter(terms, lambda t: ~F.lower(t).isin([g.lower() for g in generic]))
    return F.array_union(terms, existing) if existing is not None else terms


def parse_expansion(response: str, query: str, sortable: tuple[str, ...] = (), filterable: tuple[str, ...] = ()) -> dict:
    """Terms and hints of one response; hints must name known fields."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", response.strip())).strip()
    out = {"terms": [query], "sort_hint": None, "subject_terms": None, "filter_hint": None}
    try:
        found = json.loads(text)
    except ValueError:
        return out
    if isinstance(found, list):
        return out | ({"terms": found} if len(found) > 1 else {})
    if not isinstance(found, dict) or not isinstance(found.get("terms"), list):
        return out
    if len(found["terms"]) > 1:
        out["terms"] = found["terms"]
    sort = found.get("sort")
    if isinstance(sort, dict) and sort.get("field") in sortable and sort.get("direction") in ("asc", "desc"):
        out["sort_hint"] = {"field": sort["field"], "direction": sort["direction"]}
    subjects = found.get("subject_terms")
    if isinstance(subjects, list):
        out["subject_terms"] = [s for s in subjects if isinstance(s, str) and s] or None
    named = found.get("filters")
    if isinstance(named, dict):
        out["filter_hint"] = {k: v for k, v in named.items() if k in filterable and isinstance(v, str) and v} or None
    return out


def resolve_prompt(name: str, site_name: str, site_description: str = "", languages: tuple[str, ...] = (), sortable: tuple[str, ...] = (), filterable: dict[str, list[str]] | None = None) -> str:
    """A prompt with its blanks filled, and blocks for languages, sort fields and filters where they apply."""
    out = PROMPTS[name].replace("{SITE_NAME}", site_name).replace("{SITE_DESCRIPTION}", site_description)
    if len(languages) > 1:
        out += f"\nAnswer in the language of the question if it is one of: {', '.join(languages)}."
    if sortable:
        out += f"\nIf an order is asked for, add sort with field (one of {', '.join(sortable)}) and direction."
    if filterable:
        out += "\nIf a value is meant, add filters from: " + "; ".join(f"{k}: {', '.join(v)}" for k, v in filterable.items()) + "."
    return out


class Expander:
    """Query expansion with an injected client and cache. Any failure gives the query itself."""

    def __init__(self, client: Callable[[str, str], str], cache: dict | None = None, generation: int = 0, enrich: Callable[[str, str], str] | None = None, **fields: tuple[str, ...]):
        self.client, self.cache, self.generation, self.enrich, self.fields = client, {} if cache is None else cache, generation, enrich, fields

    def expand(self, query: str, prompt: str) -> dict:
        query = query.strip()
        if not 1 <= len(query) <= LIMITS["query"]:
            return {"ok": False, "status": 400, "terms": []}
        key = ("expand", self.generation, query.lower())
        if key not in self.cache:
            try:
                text = self.enrich(prompt, query) if self.enrich else prompt
                self.cache[key] = parse_expansion(self.client(text, query), query, **self.fields)
            except Exception:
                return {"ok": True, "status": 200, **parse_expansion("", query)}
        return {"ok": True, "status": 200, **self.cache[key]}

    def summarize(self, context: str, prompt: str) -> dict:
        if not 1 <= len(context) <= LIMITS["context"]:
            return {"ok": False, "status": 400}
        try:
            return {"ok": True, "status": 200, "summary": self.client(prompt, context)}
        except Exception:
            return {"ok": True, "status": 200}


def match_priority_pages(priority: DataFrame, terms: list[str], least: int = 1) -> DataFrame:
    """Priority pages whose keywords hold a query term, most matches first. priority: url, title, keywords (array)."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms] or [F.lit("")])
    matched = F.size(F.array_intersect(F.transform("keywords", F.lower), wanted))
    return priority.withColumn("matched", matched).where(F.col("matched") >= least).orderBy(F.desc("matched"), "url")


def version_key(name: Column) -> Column:
    """Numeric parts of a name, for comparing versions piece by piece."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(?:^|[-.])(\d+)(?=$|[-.])"), F.lit(1)), lambda p: p.cast("int"))


def newest_of_family(models: DataFrame, family: Column, name: str = "name", parts: int = 6) -> DataFrame:
    """The highest version of each family; missing parts count as 0."""
    key = version_key(F.col(name))
    padded = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.coalesce(F.get(key, i), F.lit(0)))
    return models.groupBy(family.alias("family")).agg(F.max_by(name, padded).alias("name"))


def first_working(*clients: Callable[[str, str], str]) -> Callable[[str, str], str]:
    """A client that asks the given ones in turn and gives the first answer; the last error if there is none."""

    def ask(prompt: str, text: str) -> str:
        error: Exception = ValueError("no client")
        for client in clients:
            try:
                return client(prompt, text)
            except Exception as e:
                error = e
        raise error

    return ask
