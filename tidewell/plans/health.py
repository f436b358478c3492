"""State of a published static index, and checks of a setup."""

from __future__ import annotations

import json
import os

from ..sources.sink import StaticFormat, read_file


def health(folder: str, fmt: StaticFormat = StaticFormat(), ai_key: str | None = None, sample: int = 5) -> dict:
    """Whether an index is there, how many pages it names, stale '/id.html' URLs among the first fragments."""
    entry = f"{folder}/{fmt.stem}-entry.json"
    if not os.path.exists(entry):
        return {"status": "missing", "pages": 0, "stale_urls": 0, "ai": bool(ai_key)}
    names = sorted(n for n in os.listdir(f"{folder}/fragment") if n.endswith(fmt.fragment))[:sample]
    urls = [json.loads(read_file(f"{folder}/fragment/{n}", fmt))["url"] for n in names]
    stale = sum(u.count("/") == 1 and u.endswith(".html") for u in urls)
    languages = json.loads(open(entry).read())["languages"]
    return {"status": "degraded" if stale else "ok", "pages": sum(x["page_count"] for x in languages.values()), "stale_urls": stale, "ai": bool(ai_key)}


def setup_checks(folder: str, scratch: str) -> list[tuple[str, bool, str]]:
    """(check, passed, advice)."""
    import pyspark

    return [
        ("spark", int(pyspark.__version__.split(".")[0]) >= 4, "Spark 4 or later"),
        ("output folder", os.access(os.path.dirname(os.path.abspath(folder)), os.W_OK), "a folder that can be written"),
        ("scratch folder", bool(scratch), "set spark.checkpoint.dir to a shared folder"),
    ]


def exit_code(checks: list[tuple[str, bool, str]]) -> int:
    return int(not all(ok for _, ok, _ in checks))
