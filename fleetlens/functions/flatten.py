"""Flatten collected folders by removing a subfolder name.

For each file, the first subfolder (in argument order) found in its directory
moves it; the **first occurrence** of that name is removed from the directory
(a plain substring test by default, as the original helper does; with
``segment=True`` only a whole path segment matches).  Several files arriving
at one destination: the last mover wins (``operators.dedupe.last_wins``),
ordered by subfolder argument order, then source path.  ``emptied_dirs`` and ``replaced_files`` tell what the moves leave empty and
what they replace.

The subfolder list is a parameter, so matching is a row-local ``CASE`` over
it: no join at all.  Nothing is moved: the result is the move plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.dedupe import last_wins
from fleetlens.session import ensure_checkpoint_dir


def _join_path(folder, name):
    """``os.path.join(folder, name)``: no separator is added after an empty
    folder or one that already ends with ``/``."""
    return F.when((folder == "") | folder.endswith("/"), F.concat(folder, name)) \
            .otherwise(F.concat(folder, F.lit("/"), name))


def _next_dir(d: Column, subfolders: list[str], segment: bool) -> Column:
    """The folder without the first occurrence of the first name that it has; the same folder if it has none."""
    out = d
    for name in reversed(subfolders):
        needle = f"{name.rstrip('/')}/" if segment else name
        cut = len(name.rstrip("/")) if segment else len(name)
        at = F.instr(F.concat(d, F.lit("/")) if segment else d, F.lit(needle))
        out = F.when(at > 0, F.concat(F.substring(d, F.lit(1), at - 1), F.substring(d, at + cut, F.length(d)))).otherwise(out)
    return out


def chained_moves(files: DataFrame, dir_col: str, file_col: str, subfolders, segment: bool = False, tiebreak=()) -> DataFrame:
    """``files`` with ``final`` (the path where each ends; null: replaced on the way), ``moves`` and ``replaced_at`` where destinations
    are sources themselves.

    Folders are gone through once, a folder before those in it and neighbours by name.  All files that a folder has at its turn
    move to its name without the first subfolder found, and a file that is there already is replaced.  So a file moves on if
    it comes to a folder whose turn is still ahead, and stays in one whose turn was before.  A folder that is not
    there at the start has no turn.  Names that only a file order can tell apart: ``tiebreak``.

    Every move leaves a folder one step nearer to a name without subfolders, so arrivals at the folders of one distance come only from
    those of the next larger one: one last-wins selection for each distance, of which there are as many as
    a folder's name holds subfolders.  No files: no rows."""
    subfolders, tiebreak = list(subfolders), list(tiebreak)
    probe = F.concat(F.col(dir_col), F.lit("/"))
    most = files.agg(F.max(sum((F.length(probe) - F.length(F.replace(probe, F.lit(n), F.lit("")))) for n in subfolders))).first()[0] or 0
    # each folder's names on the way, from its own to the last
    way = F.aggregate(F.sequence(F.lit(1), F.lit(max(int(most), 1))), F.array(F.col(dir_col)), lambda w, _: F.when(
        _next_dir(F.element_at(w, -1), subfolders, segment) != F.element_at(w, -1),
        F.concat(w, F.array(_next_dir(F.element_at(w, -1), subfolders, segment)))).otherwise(w))
    keep = files.columns
    ensure_checkpoint_dir(files.sparkSession)
    # stored, here and after each selection: a plan would hold every step's plan several times
    x = files.withColumn("_cm_way", way).checkpoint().withColumn("_cm_left", F.size("_cm_way") - 1)
    distance = x.agg(F.max("_cm_left")).first()[0] or 0
    # folders that have a turn: those of files, and all above them
    parts = F.split(F.col(dir_col), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    turns = files.select(F.explode(above).alias("_cm_here")).distinct().withColumn("_cm_has", F.lit(True))
    own = x.select(F.struct(*keep).alias("_cm_own"), F.col(dir_col).alias("_cm_first"), F.col(file_col).alias("_cm_file"), "_cm_way", "_cm_left",
                   F.lit(None).cast("array<string>").alias("_cm_came"), F.lit(0).alias("_cm_moves"),
                   F.struct(*[F.col(c) for c in tiebreak], F.lit(0).alias("_cm_none")).alias("_cm_tie"))
    moving, done = None, []
    for k in range(int(distance), -1, -1):
        here = own.where(F.col("_cm_left") == k)
        here = here if moving is None else here.unionByName(moving)
        at = F.element_at("_cm_way", -1 - k)
        here = here.withColumn("_cm_here", at).join(turns, "_cm_here", "left")
        turn = F.split("_cm_here", "/")
        # before: there when the folder's turn comes (from the start, or arrived since); it leaves then if its name has a subfolder
        leaves = F.lit(k > 0) & F.coalesce("_cm_has", F.lit(False)) & F.coalesce(F.col("_cm_came") < turn, F.lit(True))
        here = here.withColumn("_cm_leaves", leaves)
        here = last_wins(here, ["_cm_here", "_cm_file", "_cm_leaves"], ["_cm_came", "_cm_tie"]).checkpoint()
        path = _join_path(F.col("_cm_here"), F.col("_cm_file"))
        done.append(here.where(~F.col("kept") | ~F.col("_cm_leaves")).select(
            "_cm_own", F.when(F.col("kept"), path).alias("final"), F.col("_cm_moves").alias("moves"), F.when(~F.col("kept"), path).alias("replaced_at")))
        moving = here.where(F.col("kept") & F.col("_cm_leaves")).withColumn("_cm_came", turn) \
            .withColumn("_cm_moves", F.col("_cm_moves") + 1).select(*own.columns)
    out = reduce(DataFrame.union, done)
    return out.select(*[F.col("_cm_own")[c].alias(c) for c in keep], "final", "moves", "replaced_at")


def flatten_paths(files: DataFrame, dir_col: str, file_col: str, subfolders,
                  segment: bool = False, tiebreak=()) -> DataFrame:
    """Files (one row per file, ``dir_col`` + ``file_col``) -> moved files
    with ``src``, ``dst``, ``subfolder``, ``subfolder_idx`` and ``kept``.
    ``tiebreak`` columns complete the last-wins order when two files share a
    source path."""
    subfolders = list(subfolders)
    d = F.col(dir_col)
    # segment mode probes "<dir>/" for "<name>/" so only whole segments match
    probe = F.concat(d, F.lit("/")) if segment else d
    needles = [f"{s.rstrip('/')}/" if segment else s for s in subfolders]
    cuts = [len(s.rstrip('/')) if segment else len(s) for s in subfolders]

    idx = None
    for i, n in enumerate(needles):
        hit = F.instr(probe, F.lit(n)) > 0
        idx = F.when(hit, F.lit(i)) if idx is None else idx.when(hit, F.lit(i))
    pick = lambda vals: F.get(F.array(*[F.lit(v) for v in vals]), F.col("subfolder_idx"))
    x = (files.withColumn("subfolder_idx", idx)
              .filter(F.col("subfolder_idx").isNotNull())
              .withColumn("subfolder", pick(subfolders))
              .withColumn("_fp_pos", F.instr(probe, pick(needles)))
              .withColumn("_fp_cut", pick(cuts)))
    q = f"`{dir_col}`"
    dst_dir = F.expr(f"concat(substring({q}, 1, _fp_pos - 1), substring({q}, _fp_pos + _fp_cut))")
    x = (x.withColumn("src", _join_path(d, F.col(file_col)))
          .withColumn("dst", _join_path(dst_dir, F.col(file_col)))
          .drop("_fp_pos", "_fp_cut"))
    return last_wins(x, ["dst"], ["subfolder_idx", "src", *tiebreak])


def emptied_dirs(files: DataFrame, moves: DataFrame, dir_col: str) -> DataFrame:
    """Folders that the moves leave without a file (``dir``): all their files move."""
    before = files.groupBy(F.col(dir_col).alias("dir")).agg(F.count(F.lit(1)).alias("_fp_n"))
    gone = moves.groupBy(F.col(dir_col).alias("dir")).agg(F.count(F.lit(1)).alias("_fp_m"))
    return before.join(gone, "dir").filter("_fp_n = _fp_m").select("dir")


def replaced_files(files: DataFrame, moves: DataFrame, dir_col: str, file_col: str) -> DataFrame:
    """Files that stay where they are and are replaced by one that moves there (``path``, once each)."""
    path = _join_path(F.col(dir_col), F.col(file_col)).alias("path")
    return files.select(path).join(moves.select(F.col("dst").alias("path")), "path", "left_semi") \
        .join(moves.select(F.col("src").alias("path")), "path", "left_anti").distinct()
