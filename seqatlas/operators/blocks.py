"""Exact searches over pairs of vectors that open only blocks which can matter.

Vectors are dealt to the nearest of a bounded number of pivots; a pivot knows the radius of its block
and the largest weight in it. A row first meets the members of its own tile, which gives it a
result to beat. By the triangle inequality no member of a block is nearer than the distance to its pivot less
the radius, so a block that can't beat the result is never opened. Neighbouring blocks share a tile, and large ones are
cut, so a tile has bounded size, however many rows lie at one pivot, and a row is sent to few tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.session import cut_lineage

MOST_PIVOTS = 1_024  # of one group; their vectors are sent to every task
SLACK = 1e-9  # of a bound, for rounding
TILES = 8  # of a group, until its tiles have MOST_ROWS rows
MOST_ROWS = 16_384
CELLS = 2_000_000  # distances held at once


def tile_rows(rows, least: int):
    """Rows of a tile: ``least``, more in large groups. Rows are copied once per tile, so their number must not
    grow with the group; tasks work through a tile in slabs."""
    return np.clip(np.ceil(rows / TILES), least, max(least, MOST_ROWS)).astype(int)


def slabs(rows: int, others: int):
    """Slices of rows that meet all others within ``CELLS`` distances."""
    step = max(CELLS // max(others, 1), 1)
    return (slice(i, i + step) for i in range(0, rows, step))


@dataclass(frozen=True)
class Blocks:
    """Rows with their pivot (``_p``) and tile (``_part``) and, per group, pivot vectors, block figures and which
    tiles hold members of which pivot (``tiles``)."""

    rows: DataFrame
    pivots: dict
    groups: tuple[str, ...]
    ident: str
    vector: str
    block_rows: int
    single: bool = False  # every group is one tile, so nothing has to be opened besides

    @property
    def tile(self) -> list[str]:
        return [*self.groups, "_part"]


def _key(values) -> tuple:
    return tuple(None if v is None or v != v else v for v in values)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed by differences in the order of the components."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += np.square(a[:, i, None] - b[None, :, i])
    return out


def deal(df: DataFrame, ident: str, vector: str, groups: Sequence[str], *, weight: str | None = None, block_rows: int = 2_048, most_pivots: int = MOST_PIVOTS) -> Blocks:
    """Deal the rows of each group to about sqrt(n) pivots, ``most_pivots`` at most, chosen by a hash of the id.

    Groups that all fit one tile of ``block_rows`` rows need none. Tiles of large groups have more rows (``tile_rows``).
    """
    from seqatlas.operators.ranking import top_per_group

    groups = list(groups)
    columns = [*groups, ident, vector, *([weight] if weight else [])]
    rows = df.select(*columns)
    sizes = {_key(r[:-1]): r[-1] for r in rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).collect()}
    if max(sizes.values(), default=0) <= block_rows:
        one = rows.withColumns({"_p": F.lit(0), "_away": F.lit(0.0), "_part": F.lit(0)})
        return Blocks(one, {}, tuple(groups), ident, vector, block_rows, single=True)
    wanted = {g: int(min(max(round(n**0.5), 1), most_pivots)) for g, n in sizes.items()}
    first = top_per_group(rows, groups, [F.xxhash64(ident), F.col(ident)], max(wanted.values(), default=1), rank="_nth")
    chosen: dict = {g: [] for g in wanted}
    for r in first.select(*groups, "_nth", vector).collect():
        g = _key(r[: len(groups)])
        if r["_nth"] <= wanted[g]:
            chosen[g].append((r["_nth"], r[vector]))
    centers = {g: np.array([v for _, v in sorted(c)], float) for g, c in chosen.items()}

    def place(batches):
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False) if groups else [((), batch)]:
                near = _apart(_stack(part[vector]), centers[_key(key if isinstance(key, tuple) else (key,))])
                out = part.copy()
                out["_p"] = near.argmin(1).astype("int32")
                out["_away"] = np.sqrt(near.min(1))
                yield out

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in columns], "_p int, _away double"])
    placed = cut_lineage(rows.mapInPandas(place, schema))
    figures = placed.groupBy(*groups, "_p").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_away").alias("_radius"), F.max(weight if weight else F.lit(0.0)).alias("_weight")
    )
    pivots: dict = {g: {"center": c, "radius": np.full(len(c), -np.inf), "weight": np.zeros(len(c)), "rows": np.zeros(len(c), int)} for g, c in centers.items()}
    raw = {}
    # One row per pivot.
    for r in figures.collect():
        g = _key(r[: len(groups)])
        raw[g], own = tuple(r[: len(groups)]), pivots[g]
        own["radius"][r["_p"]], own["weight"][r["_p"]], own["rows"][r["_p"]] = r["_radius"], r["_weight"], r["_n"]
    places = [(*raw[g], *place_) for g in raw for place_ in _fill_tiles(pivots[g], int(tile_rows(sizes[g], block_rows)))]
    schema = ", ".join([*[f"{c} {types[c]}" for c in groups], "_p int, _start int, _parts int"])
    where = df.sparkSession.createDataFrame(places, schema)
    same = F.lit(True)
    for c in [*groups, "_p"]:
        same = same & F.col(f"_r.{c}").eqNullSafe(F.col(f"_f.{c}"))
    sized = placed.alias("_r").join(F.broadcast(where.alias("_f")), same)
    part = F.col("_start") + F.pmod(F.xxhash64(ident), F.col("_parts")).cast("int")
    tiled = sized.select(*[F.col(f"_r.{c}").alias(c) for c in placed.columns], part.alias("_part"))
    return Blocks(tiled, pivots, tuple(groups), ident, vector, int(tile_rows(max(sizes.values()), block_rows)))


def _fill_tiles(own: dict, rows: int) -> list[tuple[int, int, int]]:
    """(pivot, first tile, number of tiles) of each pivot with members, in a walk from pivot to nearest pivot; ``own``
    gets ``tiles`` (pivots by tiles). Small blocks share a tile of at most a ``TILES``-th of the group, so that bounds still
    tell tiles apart; a pivot with more than ``rows`` members has tiles of its own."""
    together = min(rows, -(-int(own["rows"].sum()) // TILES))
    left = list(np.flatnonzero(own["rows"]))
    walk = [left.pop(0)] if left else []
    while left:
        apart = np.square(own["center"][left] - own["center"][walk[-1]]).sum(1)
        walk.append(left.pop(int(apart.argmin())))
    out, tile, held = [], 0, 0
    for p in walk:
        n = int(own["rows"][p])
        parts = -(-n // rows)
        if held and (parts > 1 or held + n > together):
            tile, held = tile + 1, 0
        out.append((int(p), tile, parts))
        tile, held = (tile + parts, 0) if parts > 1 else (tile, held + n)
    own["tiles"] = np.zeros((len(own["rows"]), tile + 1))
    for p, start, parts in out:
        own["tiles"][p, start : start + parts] = 1
    return out


def own_tile(blocks: Blocks, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``meet(rows, members)`` of every tile with itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return meet(pdf, pdf)

    return blocks.rows.groupBy(*blocks.tile).applyInPandas(run, schema)


def opened(blocks: Blocks, rows: DataFrame, wants: Callable[[pd.DataFrame, np.ndarray, dict], np.ndarray]) -> DataFrame:
    """The rows once for every tile (``_part``) they have to meet besides their own.

    ``rows`` are the dealt rows with what they have to beat; ``wants(rows, distance to pivots, figures)`` says which
    pivots' blocks might.
    """
    groups, pivots, vector = list(blocks.groups), blocks.pivots, blocks.vector
    columns = rows.columns

    def run(batches):
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False) if groups else [((), batch)]:
                figures = pivots[_key(key if isinstance(key, tuple) else (key,))]
                away = np.sqrt(_apart(_stack(part[vector]), figures["center"]))
                wanted = (wants(part, away, figures) & (figures["rows"] > 0)).astype(float) @ figures["tiles"] > 0
                wanted[np.arange(len(part)), part["_part"].to_numpy()] = False
                # A tile at a time: a batch never holds its rows more than twice.
                for tile in np.flatnonzero(wanted.any(0)):
                    out = part[wanted[:, tile]].copy()
                    out["_part"] = np.int32(tile)
                    yield out[columns]

    return rows.mapInPandas(run, rows.schema)


def visit(blocks: Blocks, queries: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``meet(rows, members)`` of queries with the tiles they open, in chunks of at most about ``block_rows`` queries."""
    tile = blocks.tile
    queries = cut_lineage(queries)
    sizes = queries.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / blocks.block_rows).cast("int").alias("_chunks"))

    def with_chunks(df: DataFrame, chunk) -> DataFrame:
        same = F.lit(True)
        for c in tile:
            same = same & F.col(f"_q.{c}").eqNullSafe(F.col(f"_s.{c}"))
        joined = df.alias("_q").join(sizes.alias("_s"), same)
        return joined.select(*[F.col(f"_q.{c}").alias(c) for c in df.columns], chunk.alias("_chunk"))

    asked = with_chunks(queries, F.pmod(F.xxhash64(F.col(f"_q.{blocks.ident}")), F.col("_s._chunks")).cast("int"))
    members = with_chunks(blocks.rows, F.explode(F.sequence(F.lit(0), F.col("_s._chunks") - 1)))
    by = [*tile, "_chunk"]

    def run(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        return meet(asks, there) if len(asks) and len(there) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return asked.groupBy(*by).cogroup(members.groupBy(*by)).applyInPandas(run, schema)
