"""Features kept beside the quotes they come from: after a commit only what it can have changed is computed again.

The features' manifest holds the version of the quotes that they were made from. Folders are written once, so a month has
changed exactly if its folders differ between that version and the last. A changed month changes the features of its
own sessions and of those that look back to it; they need the months that they look back to, and no others are read.
The months' numbers of sessions are in the manifest, so no table is read to find them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.operators.features import rolling_features
from tidemark.operators.panel import dense
from tidemark.settings import FeatureSettings
from tidemark.sources import versions


def _folders(manifest: dict) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for p in manifest["parts"]:
        out[p["part"]] = (*out.get(p["part"], ()), p["path"])
    return out


def reach(months: list[str], sessions: dict[str, int], start: set[str], far: int, step: int) -> set[str]:
    """``start`` and the months up to ``far`` sessions after (step 1) or before (step -1) any of them."""
    out = set(start)
    for i, month in enumerate(months):
        if month in start:
            left, j = far, i + step
            while left > 0 and 0 <= j < len(months):
                out.add(months[j])
                left -= sessions.get(months[j], 0)
                j += step
    return out


def plan(old: dict, new: dict, far: int) -> tuple[set[str], set[str]]:
    """(months whose features may have changed, months to read for them) between two manifests of the quotes."""
    before, now = _folders(old), _folders(new)
    sessions: dict[str, int] = {}
    for p in new["parts"]:
        sessions[p["part"]] = sessions.get(p["part"], 0) + p["sessions"]
    months = sorted(before.keys() | now.keys())
    changed = {m for m in months if before.get(m) != now.get(m)}
    affected = reach(months, sessions, changed, far, 1)
    return affected, reach(months, sessions, affected, far, -1)


def refresh(spark: SparkSession, quotes: str, features: str, settings: FeatureSettings = FeatureSettings()) -> tuple[set[str], set[str]]:
    """Brings the features below ``features`` up to the last version of the quotes below ``quotes``.

    They have a row for each quote. Returns the months written and those read: all at first, and where the version they were made from has expired.
    """
    new, kept = versions.manifest(spark, quotes), versions.manifest(spark, features)
    if kept["batch"] == new["version"]:
        return set(), set()
    known = kept["batch"] is not None and kept["batch"] in versions.numbers(spark, quotes)
    old = versions.manifest(spark, quotes, kept["batch"]) if known else {"parts": []}
    affected, needed = plan(old, new, settings.look_back)
    if not known:
        affected |= {p["part"] for p in kept["parts"]}
    rows = versions.read_parts(spark, quotes, "quotes", needed, new["version"])
    rows = rolling_features(dense(rows, order="close"), settings).filter("close is not null")
    versions.replace_parts(features, "features", rows.select(*versions.DERIVED["features"].names), affected, f"quotes {new['version']}", new["version"])
    return affected, needed
