"""File addresses: bring paths and old storage addresses to one base."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FileStore:
    """Where files are served from.

    ``endpoint`` may carry a scheme.  Absolute addresses are moved to it only
    when ``replace_old`` is set and they contain one of ``old_markers``.
    """

    endpoint: str = ""
    replace_old: bool = False
    old_markers: tuple[str, ...] = field(default=())

    @property
    def scheme(self) -> str:
        for known in ("http", "https", "s3"):
            if self.endpoint.startswith(known + "://"):
                return known
        return "https"

    @property
    def host(self) -> str:
        return self.endpoint.split("://", 1)[-1].rstrip("/")


def url_protocol(url: Column) -> Column:
    """http, https or s3 when the text starts with it and "://", else null."""
    return F.nullif(F.regexp_extract(url, r"^(https?|s3)://", 1), F.lit(""))


def _cases(url: Column, store: FileStore):
    """(outcome, condition, new address) in order of precedence."""
    base = f"{store.scheme}://{store.host}/"
    relative = url_protocol(url).isNull()
    path = F.regexp_replace(url, "^/+", "")
    yield "prefixed", relative & path.startswith(store.host), F.concat(
        F.lit(store.scheme + "://"), path
    )
    yield "prefixed", relative, F.concat(F.lit(base), path)
    if store.replace_old and store.old_markers:
        after_scheme = F.regexp_replace(url, r"^[^:]*://", "")
        yield "current", after_scheme.startswith(store.host), url
        marked = F.lit(False)
        for marker in store.old_markers:
            marked = marked | F.contains(url, F.lit(marker))
        # what follows the first slash behind a host that is not empty
        slash = F.locate("/", after_scheme)
        rest = F.when(slash > 1, F.substr(after_scheme, slash + 1)).otherwise("")
        yield "migrated", marked & (rest != ""), F.concat(F.lit(base), rest)


def build_file_url(url: Column, store: FileStore) -> Column:
    if not store.endpoint:
        return url
    out = None
    for _, condition, address in _cases(url, store):
        out = F.when(condition, address) if out is None else out.when(condition, address)
    return out.otherwise(url)


def url_outcome(url: Column, store: FileStore) -> Column:
    """What ``build_file_url`` does: prefixed, current, migrated or left."""
    if not store.endpoint:
        return F.lit("left")
    out = F.when(url.isNull(), F.lit(None).cast("string"))
    for name, condition, _ in _cases(url, store):
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit("left"))


def rewrite_file_urls(df: DataFrame, column: str, store: FileStore) -> DataFrame:
    """Add ``new_url`` and ``url_outcome`` for the address column."""
    return df.withColumns(
        {
            "new_url": build_file_url(F.col(column), store),
            "url_outcome": url_outcome(F.col(column), store),
        }
    )


def outcome_counts(df: DataFrame, column: str = "url_outcome") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
