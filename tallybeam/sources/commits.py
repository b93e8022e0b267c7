"""Commits: folders of several tables written aside and then put in place under a record.

A commit of some name below a root has ``_pending/<name>``, which readers don't list. Folders are staged there; then a record
says which folder takes which place and which are removed, and from that moment the commit happens: whoever comes next
(:func:`finish`) carries it out, however often it was cut off. Without a record it has not happened, and what was staged is
dropped when the same name is begun again. Until the record is there, tables are as they were.

One commit of a name runs at a time. A reader that lists folders while they are moved may see some of them.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tallybeam.sources import folders

Moves = list[tuple[str | None, str]]
AT_ONCE = 8  # folders moved side by side; on shared storage each waits for the answer


def reached(step: str) -> None:
    """Called where a run may be cut off: ``staged``, ``recorded``, before each move, ``moved``. Tests raise here."""


def staging(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_pending/{folders.checked(name)}"


def begin(spark: SparkSession, root: str, name: str) -> str:
    """The empty staging folder of a commit, earlier commits below the root carried out."""
    finish(spark, root)
    aside = staging(root, name)
    folders.remove(spark, [aside])
    folders.make(spark, aside)
    return aside


def commit(spark: SparkSession, root: str, name: str, moves: Moves) -> None:
    """Put staged folders in place: ``(staged, place)``, or ``(None, place)`` for a place that becomes empty.

    Paths are relative to the staging folder and to the root.
    """
    aside = staging(root, name)
    reached("staged")
    folders.write_text(spark, f"{aside}/record.draft", json.dumps(moves))
    folders.rename(spark, f"{aside}/record.draft", f"{aside}/record")
    reached("recorded")
    _carry_out(spark, root, aside)


def finish(spark: SparkSession, root: str) -> None:
    """Carry out the recorded commits below a root that were cut off."""
    for record in folders.matching(spark, f"{root}/_pending/*/record"):
        _carry_out(spark, root, record.removesuffix("/record"))


def _carry_out(spark: SparkSession, root: str, aside: str) -> None:
    def move(staged: str | None, place: str) -> None:
        reached("moving")
        if staged is None:
            folders.remove(spark, [f"{root}/{place}"])
        else:
            folders.replace(spark, f"{aside}/{staged}", f"{root}/{place}")

    moves = json.loads(folders.read_text(spark, f"{aside}/record"))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for moved in [pool.submit(move, *one) for one in moves]:
            moved.result()
    reached("moved")
    # The record goes last, so that a cut within the removal leaves nothing that looks unrecorded but half moved.
    folders.remove(spark, [p for p in folders.matching(spark, f"{aside}/*") if not p.endswith("/record")])
    folders.remove(spark, [aside])


def replacing(spark: SparkSession, root: str, aside: str, table: str, batch: str, skip: frozenset[str] = frozenset()) -> Moves:
    """Moves that give a table the staged folders of a batch in place of those it has; days of ``skip`` stay as they are.

    ``table`` is its folder below the root, empty for the root itself.
    """
    at = f"{table}/day=" if table else "day="
    staged, old = (
        {
            name
            for p in folders.matching(spark, f"{base}/{at}*/batch={folders.checked(batch)}")
            if (name := p.rpartition("/day=")[2]).partition("/")[0] not in skip
        }
        for base in (aside, root)
    )
    return [(at + name if name in staged else None, at + name) for name in sorted(staged | old)]


def whole_days(spark: SparkSession, aside: str, table: str, days: list[str]) -> Moves:
    """Moves that give a table the staged folders of whole days; a day without a staged folder becomes empty."""
    staged = set(folders.partition_values(spark, f"{aside}/{table}", "day"))
    return [(f"{table}/day={day}" if day in staged else None, f"{table}/day={day}") for day in days]
