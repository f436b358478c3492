"""Search configuration: preset, then overrides; strings are read as their field's type."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

#: Named presets, as changes of the defaults.
PRESETS: dict[str, dict] = {
    "content": {},
    "catalog": {"title_match_boost": 3.0, "recency_strategy": "none", "subword_max_frequency": 0.1},
    "reference": {"recency_strategy": "none", "phrase_adjacent_multiplier": 3.0},
}


@dataclass(frozen=True)
class SearchConfig:
    recency_strategy: str = "exponential"
    recency_boost_max: float = 0.25
    recency_half_life_days: int = 365
    recency_penalty_after_days: int = 1825
    recency_max_penalty: float = 0.3
    title_match_boost: float = 2.0
    title_all_terms_multiplier: float = 1.5
    content_match_boost: float = 0.4
    exact_title_boost: float = 5.0
    phrase_adjacent_multiplier: float = 2.5
    phrase_near_multiplier: float = 1.5
    phrase_near_window: int = 5
    phrase_window: int = 15
    expand_primary_weight: float = 0.5
    cross_list_bonus: float = 0.05
    subword_max_frequency: float = 0.05
    specificity_floor: float = 0.15
    specificity_gate: float = 0.45
    expansion_per_term_top_k: int = 3
    filter_hint_min_results: int = 5
    filter_hint_min_share: float = 0.1
    results_per_page: int = 10
    max_results: int = 50
    excerpt_length: int = 30
    ai_enabled: bool = True
    ai_languages: tuple[str, ...] = ("en",)
    ai_summary_top_n: int = 10
    max_follow_ups: int = 3
    custom_stop_words: tuple[str, ...] = ()

    @classmethod
    def of(cls, values: dict | None = None, preset: str | None = None) -> SearchConfig:
        """Unknown names and None are passed over; the top-k of expansion terms can't be changed."""
        known = {f.name: f for f in fields(cls)}
        merged = PRESETS.get(preset or "", {}) | {k: v for k, v in (values or {}).items() if v is not None}
        own = {k: _read(v, known[k].default if known[k].default is not field else None) for k, v in merged.items() if k in known and k != "expansion_per_term_top_k"}
        return cls(**own)

    def exported(self) -> dict:
        return asdict(self)


def _read(value, like):
    if isinstance(like, bool):
        return value not in ("", "0", 0, False)  # the text 'false' is true, as any other text
    if isinstance(like, int):
        return int(float(value))
    if isinstance(like, float):
        return float(value)
    if isinstance(like, tuple):
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    return str(value)


#: Pages in a chunk and MiB of each memory profile.
PROFILES = {"conservative": (50, 96), "balanced": (200, 384), "aggressive": (500, 1024)}


def parse_bytes(text: str) -> int:
    """'512M', '1G', '64k' or plain bytes."""
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    return int(float(text[:-1] if unit > 1 else text) * unit)


def spark_settings(profile: str, cores: int) -> dict[str, str]:
    """A memory profile as Spark settings: smaller partitions and write chunks for less memory."""
    pages, mib = PROFILES[profile]
    return {"spark.sql.files.maxPartitionBytes": f"{max(8, mib // 3)}m", "spark.sql.shuffle.partitions": str(cores * (4 if pages <= 50 else 2 if pages <= 200 else 1))}
