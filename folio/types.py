"""What passes between the parts: specs of queries, tables that can be queried, results, configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame


class QueryError(ValueError):
    """A query that can't be read, or names something that isn't there."""


@dataclass(frozen=True)
class Comparison:
    column: str
    op: str
    literal: str
    quoted: bool = False


@dataclass(frozen=True)
class QuerySpec:
    """One query, clauses merged: repeated filters add up, the last `top` wins, sort keys follow one another."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()  # column, ascending
    regex: tuple[tuple[str | None, str], ...] = ()  # None: the table's own field
    where: tuple[Comparison, ...] = ()
    top: int = -1
    flags: frozenset[str] = frozenset()
    messages: tuple[str, ...] = ()


@dataclass(frozen=True)
class QueryTable:
    """A DataFrame with the columns shown by default, the fields of `!` and `recent`, and the keys that order ties."""

    df: DataFrame
    base_cols: tuple[str, ...]
    bang_field: str
    recent_field: str
    keys: tuple[str, ...] = ()

    def with_df(self, df: DataFrame) -> QueryTable:
        return replace(self, df=df)


@dataclass(frozen=True)
class QueryResult:
    """Rows of a query; counts are jobs of their own and run only when asked for."""

    df: DataFrame
    unrestricted: DataFrame
    spec: QuerySpec
    messages: tuple[str, ...] = ()

    def total(self) -> int:
        """Rows before `top`."""
        return self.unrestricted.count()

    def caption(self) -> str:
        total = self.total()
        shown = total if self.spec.top <= 0 else min(total, self.spec.top)
        return f"{shown:,d} of {total:,d} rows, {len(self.df.columns)} columns"


REF_COLUMNS = ("type", "tag", "author", "doi", "file", "journal", "pages", "title", "volume", "year", "publisher", "url", "institution", "number", "mendeley_tags", "booktitle", "edition", "month", "address", "editor", "arc_citations", "arc_source")


@dataclass
class LibraryConfig:
    """A library's settings, kept as JSON beside its tables."""

    name: str
    description: str = ""
    pdf_dir: str = ""
    text_dir: str = ""
    extractor: str = "pdftotext"
    timezone: str = "UTC"
    watched_dirs: list[str] = field(default_factory=list)
    ref_columns: list[str] = field(default_factory=lambda: list(REF_COLUMNS))

    def save(self, directory: str) -> None:
        """Writes the settings; an older file is kept beside it as config.json.bak."""
        at = Path(directory) / "config.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        if at.exists():
            at.replace(at.with_suffix(".json.bak"))
        at.write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> LibraryConfig:
        """Settings from a library's folder, from a JSON file, or, where the yaml package is there, from a YAML one.

        Settings of other names are left out, and `pdf_dir_name`, `text_dir_name` and `tz` are read as their like here.
        """
        at = Path(path) / "config.json" if Path(path).is_dir() else Path(path)
        text = at.read_text(encoding="utf-8")
        if at.suffix == ".json":
            got = json.loads(text)
        else:
            import yaml

            got = yaml.safe_load(text) or {}
        also = {"pdf_dir_name": "pdf_dir", "text_dir_name": "text_dir", "tz": "timezone"}
        own = {also.get(k, k): v for k, v in got.items()}
        return cls(**{"name": at.stem} | {f.name: own[f.name] for f in fields(cls) if own.get(f.name) is not None})
