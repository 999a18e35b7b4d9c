"""Statements that change tables: each builds a new state from files that are written once; a commit makes it the next version."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConflictError, ConstraintError, SqlError
from .store import SPARK_TYPES, Bounds, Store

RETRIES = 8
#: A large file (Store.delta_bytes), of which a statement changes no more than this share of rows, isn't written anew.
DELTA_SHARE = 0.05


class Work:
    """One transaction: a state in the making on top of a base version."""

    def __init__(self, store: Store) -> None:
        self.store, self.state = store, store.state()
        self.base, self.changed, self.staged, self.failed = self.state["version"], set(), [], False
        self.in_trigger = False
        self.used, self.busy, self.expired = time.monotonic(), False, False

    def table(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise SqlError(f"Unknown table {name}")
        return self.state["tables"][name]

    def frame(self, name: str) -> DataFrame:
        return self.store.frame(self.table(name))

    def put(self, name: str, files: list[dict]) -> None:
        self.table(name)["manifest"] = self.store.manifest(files, name)
        self.changed.add(name)

    def write(self, df: DataFrame, name: str, extra: tuple[str, ...] = ()) -> list[dict]:
        files = self.store.write(df, name, self.table(name), extra)
        self.staged += files
        return files

    def commit(self) -> int:
        if not self.changed:
            return self.base
        base = self.base
        for _ in range(RETRIES):
            self.state["changed"] = sorted(self.changed)
            if self.store.commit(self.state, base):
                return base + 1
            # others' tables are taken over; a table that both changed is a conflict
            latest = self.store.state()
            for v in range(base + 1, latest["version"] + 1):
                if set(self.store.state(v)["changed"]) & self.changed or "*" in self.changed:
                    self.rollback()
                    raise ConflictError(f"version {v} changed the same tables")
            for name in self.changed:
                latest["tables"][name] = self.state["tables"][name]
            self.state, base = latest, latest["version"]
        self.rollback()
        raise ConflictError("too many other writers")

    def rollback(self) -> None:
        self.store.remove(self.staged)
        self.staged, self.changed = [], set()

    # checks

    def names(self, t: dict) -> list[str]:
        return [c["name"] for c in t["columns"]]

    def check_rows(self, name: str, df: DataFrame, check: Callable[[dict, str], str]) -> int:
        """Nulls, enums and CHECKs of rows about to be visible, in one aggregation over the written files; how many rows there are."""
        t = self.table(name)
        tests = [("null", f"{c['name']} may not be null", F.col(f"`{c['name']}`").isNull()) for c in t["columns"] if not c["nullable"]]
        tests += [("type", f"{c['name']} must be finite", F.isnan(f"`{c['name']}`") | (F.abs(f"`{c['name']}`") == float("inf"))) for c in t["columns"] if c["type"] == "number"]
        tests += [("enum", f"{c['name']} has a value that isn't listed", ~F.col(f"`{c['name']}`").isin(c["enum"])) for c in t["columns"] if c.get("enum")]
        tests += [("check", f"CHECK ({k}) fails", F.expr(f"({check(t, k)}) IS FALSE")) for k in t["checks"]]
        n, *bad = df.agg(F.count("*").alias("n"), *(F.max(F.coalesce(x, F.lit(False))).alias(f"t{i}") for i, (_, _, x) in enumerate(tests))).first()
        for (code, message, _), hit in zip(tests, bad, strict=True):
            if hit:
                raise ConstraintError(code, f"{name}: {message}")
        return n

    def check_unique(self, name: str, df: DataFrame, against: DataFrame | None) -> None:
        key = self.table(name)["key"]
        if key is None:
            return
        k = F.col(f"`{key}`")
        twice = df.groupBy(k.alias("k")).count().where("count > 1").limit(1).collect()
        if not twice and against is not None:
            twice = df.select(k.alias("k")).join(against.select(k.alias("k")), "k", "left_semi").limit(1).collect()
        if twice:
            raise ConstraintError("unique", f"{name}: duplicate {key} {twice[0]['k']!r}")

    def near(self, t: dict, before: list[dict], files: list[dict]) -> DataFrame | None:
        """Rows of those files that can have a key of new ones, by their bounds; None if there are none: rows at a table's end are
        compared with nothing."""
        if t["key"] is None or not files:
            return None
        ends = [(f["low"], f["high"]) for f in files]
        whole = Bounds() if any(a is None or b is None for a, b in ends) else Bounds(min(a for a, _ in ends), max(b for _, b in ends))
        met = [f for f in before if whole.meets(f)]
        return self.store.frame(t, met) if met else None

    def check_references(self, name: str, df: DataFrame) -> None:
        for r in self.table(name)["refs"]:
            parent = self.table(r["table"])
            key = r["parent"] or parent["key"]
            c = F.col(f"`{r['column']}`")
            orphan = df.where(c.isNotNull()).select(c.alias("k")).join(self.frame(r["table"]).select(F.col(f"`{key}`").alias("k")), "k", "left_anti").limit(1).collect()
            if orphan:
                raise ConstraintError("reference", f"{name}: {r['column']} {orphan[0]['k']!r} isn't in {r['table']}")

    # changes; all give the rows changed, as (old, new) DataFrames over written files

    def complete(self, name: str, df: DataFrame, default: Callable[[dict], Column]) -> DataFrame:
        """Rows with all of a table's columns; those not given have their defaults."""
        t = self.table(name)
        given = set(df.columns)
        if unknown := given - set(self.names(t)):
            raise SqlError(f"{name} has no column {sorted(unknown)[0]}")
        serial = next((c for c in t["columns"] if c["default"] == "autoincrement" and c["name"] not in given), None)
        out = df.select(*(F.col(f"`{c['name']}`").cast(SPARK_TYPES[c["type"]]).alias(c["name"]) if c["name"] in given else default(c).cast(SPARK_TYPES[c["type"]]).alias(c["name"]) for c in t["columns"]))
        if serial is not None:
            out, n = self.numbered(out, name, serial["name"], int(t.get("next", 1)))
            t["next"] = int(t.get("next", 1)) + n
        return out

    def numbered(self, df: DataFrame, name: str, column: str, start: int) -> tuple[DataFrame, int]:
        """Gapless numbers, and how many. Rows are written first, with the partition and the place in it that they have then, so
        that a lost executor can't number them anew; partitions' counts, a row each, give the numbers at which they start."""
        t = self.table(name)
        tagged = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        files = self.write(tagged, name, ("_p", "_i"))
        if not files:
            return df, 0
        schema = self.store.physical(t).add("_p", "integer").add("_i", "long")
        rows = self.store.spark.read.schema(schema).parquet(*(f"{self.store.root}/{f['path']}" for f in files))
        counts = rows.groupBy("_p").agg(F.count("*").alias("n"))
        firsts = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n") + start).alias("_first"))
        numbered = rows.join(firsts, "_p")
        number = (F.col("_first") + F.col("_i")).cast("double")
        return numbered.select(*((number if c["name"] == column else F.col(c["id"])).alias(c["name"]) for c in t["columns"])), sum(f["rows"] for f in files)

    def insert(self, name: str, df: DataFrame, check: Callable) -> DataFrame:
        t = self.table(name)
        before = self.store.files(t)
        files = self.write(df, name)
        new = self.store.frame(t, files)
        self.check_rows(name, new, check)
        self.check_unique(name, new, self.near(t, before, files))
        self.put(name, before + files)
        self.check_references(name, new)
        return new

    def touched(self, t: dict, rows: DataFrame) -> tuple[DataFrame, list[dict], list[dict]]:
        """Of a table, the files that rows (with _file) are in: their rows, these files, and the others."""
        inside, kept = self.store.split(t, (r[0] for r in rows.select("_file").distinct().collect()))
        return self.store.frame(t, inside), inside, kept

    def hit_files(self, t: dict, where: Column, bounds: Bounds | None) -> tuple[list[dict], list[dict], list[dict]]:
        """The files with a row for which where is true: those to write anew, and large ones of which few rows are hit, whose
        rows are to be marked as gone; and the other files. Only files are looked at that can have a key within bounds."""
        hits = dict(self.store.with_file(t, bounds).where(where).groupBy("_file").count().collect())
        inside, kept = self.store.split(t, hits)
        few = [f for f in inside if f["bytes"] >= self.store.delta_bytes and f.get("rows") and hits[f["path"]] <= DELTA_SHARE * f["rows"]]
        return [f for f in inside if f not in few], few, kept

    def without(self, name: str, few: list[dict], where: Column) -> list[dict]:
        """The entries of files whose rows, for which where is true, are gone."""
        if not few:
            return []
        t = self.table(name)
        rows = self.store.with_file(t, files=few).where(where).select(F.col("_file").alias("f"), F.col(f"`{t['key']}`").alias("k"))
        folder = self.store.write_gone(rows, name)
        self.staged.append({"path": f"{folder}/"})
        lost = dict(self.store.spark.read.parquet(f"{self.store.root}/{folder}").groupBy("f").count().collect())
        return [{**f, "rows": f["rows"] - lost[f["path"]], "gone": [*f.get("gone", []), folder]} for f in few]

    def update(self, name: str, where: Column, sets: dict[str, Column], check: Callable, bounds: Bounds | None = None) -> tuple[DataFrame, DataFrame, int]:
        """Only files with a row for which where is true are written anew; of large ones with few such rows these alone are, and
        the old ones are marked as gone."""
        t = self.table(name)
        key = self.keyed(t, name, "UPDATE")
        anew, few, kept = self.hit_files(t, where, bounds)
        hit = F.coalesce(where, F.lit(False))

        def changed(rows: DataFrame) -> DataFrame:
            return rows.select(*(F.when(hit, sets[c].cast(rows.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in rows.columns), hit.alias("_hit"))

        parts = [self.store.frame(t, anew)] * bool(anew) + [self.store.frame(t, few).where(where)] * bool(few)
        files = self.write(reduce(DataFrame.unionByName, map(changed, parts)), name, ("_hit",)) if parts else []
        return self.finish(name, t, key, self.store.frame(t, anew + few).where(hit), files, kept + self.without(name, few, where), key in sets, check)

    def finish(self, name: str, t: dict, key: str | None, old: DataFrame, files: list[dict], kept: list[dict], key_moves: bool, check: Callable) -> tuple[DataFrame, DataFrame, int]:
        new = self.hits(t, files)
        n = self.check_rows(name, new, check)
        self.put(name, kept + files)
        if key_moves:
            self.check_unique(name, self.frame(name), None)
        self.check_references(name, new)
        return old, new, n

    def hits(self, t: dict, files: list[dict]) -> DataFrame:
        if not files:
            return self.store.frame(t, [])
        schema = self.store.physical(t).add("_hit", "boolean")
        df = self.store.spark.read.schema(schema).parquet(*(f"{self.store.root}/{f['path']}" for f in files)).where("_hit")
        return df.select(*(self.store._column(c, F.col(c["id"])) for c in t["columns"]))

    @staticmethod
    def keyed(t: dict, name: str, what: str) -> str:
        if t["key"] is None:
            raise SqlError(f"{what} requires a table with a unique key: {name} has none")
        return t["key"]

    def delete(self, name: str, where: Column, check: Callable, bounds: Bounds | None = None) -> tuple[DataFrame, int]:
        t = self.table(name)
        self.keyed(t, name, "DELETE")
        anew, few, kept = self.hit_files(t, where, bounds)
        gone = self.store.frame(t, anew + few).where(where)
        n = gone.count()
        if n:
            files = self.write(self.store.frame(t, anew).where(~F.coalesce(where, F.lit(False))), name) if anew else []
            self.put(name, kept + files + self.without(name, few, where))
            self.references_to(name, gone, check)
        return gone, n

    def references_to(self, name: str, gone: DataFrame, check: Callable) -> None:
        """RESTRICT, CASCADE and SET NULL of tables that refer to deleted rows, in the same commit."""
        for child, t in list(self.state["tables"].items()):
            for r in t["refs"]:
                if r["table"] != name:
                    continue
                key = r["parent"] or self.table(name)["key"]
                keys = gone.select(F.col(f"`{key}`").alias("_k")).distinct()
                rows = self.store.with_file(t).join(keys, F.col(f"`{r['column']}`") == F.col("_k"), "left_semi")
                inside, touched, kept = self.touched(t, rows)
                if not touched:
                    continue
                if r["action"] == "restrict":
                    raise ConstraintError("reference", f"{child} refers to deleted rows of {name}")
                marked = inside.join(keys, F.col(f"`{r['column']}`") == F.col("_k"), "left")
                if r["action"] == "null":
                    new = marked.select(*(F.when(F.col("_k").isNull(), F.col(f"`{c}`")).alias(c) if c == r["column"] else F.col(f"`{c}`") for c in inside.columns))
                    files = self.write(new, child)
                    self.check_rows(child, self.store.frame(t, files), check)
                    self.put(child, kept + files)
                else:
                    lost = marked.where("_k is not null").drop("_k")
                    files = self.write(marked.where("_k is null").drop("_k"), child)
                    self.put(child, kept + files)
                    self.references_to(child, lost, check)

    def upsert(self, name: str, df: DataFrame, columns: list[str] | None, check: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows with a new key are inserted; for the others the columns are replaced (None: nothing is done).
        Gives inserted rows, and old and new rows of the replaced."""
        t = self.table(name)
        key = self.keyed(t, name, "ON CONFLICT")
        files = self.write(df, name)
        staged = self.store.frame(t, files)
        self.check_unique(name, staged, None)
        k = F.col(f"`{key}`")
        incoming = staged.select(*(F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(staged.columns)))
        ki = staged.columns.index(key)
        fresh = staged.join(self.frame(name).select(k.alias("_k")), k == F.col("_k"), "left_anti")
        fresh_files = self.write(fresh, name)
        old = new = self.store.frame(t, [])
        listed = self.store.files(t)
        if columns is not None:
            tagged = self.store.with_file(t).join(incoming.select(f"_in_{ki}"), k == F.col(f"_in_{ki}"), "left_semi")
            inside, touched, listed = self.touched(t, tagged)
            joined = inside.join(incoming, k == F.col(f"_in_{ki}"), "left")
            hit = F.col(f"_in_{ki}").isNotNull()
            changed = joined.select(*(F.when(hit, F.col(f"_in_{i}")).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for i, c in enumerate(inside.columns)), hit.alias("_hit"))
            out = self.write(changed, name, ("_hit",)) if touched else []
            old = inside.join(incoming.select(f"_in_{ki}"), k == F.col(f"_in_{ki}"), "left_semi")
            new = self.hits(t, out)
            listed = listed + out
        inserted = self.store.frame(t, fresh_files)
        both = inserted.unionByName(new)
        self.check_rows(name, both, check)
        self.put(name, listed + fresh_files)
        self.check_references(name, both)
        return inserted, old, new

    def merge(self, name: str, source: DataFrame, alias: str, source_alias: str, on: Column, source_key: Column, branches: list[dict], default: Callable, check: Callable) -> dict:
        """branches: matched, cond (Column or None), action, sets or values (name to Column). Columns are of the aliased joined rows."""
        t = self.table(name)
        key = self.keyed(t, name, "MERGE")
        target = self.store.with_file(t).alias(alias)
        src = source.alias(source_alias)
        twice = src.groupBy(source_key.alias("k")).count().where("count > 1 and k is not null").join(self.frame(name).select(F.col(f"`{key}`").alias("k")), "k", "left_semi").limit(1).collect()
        if twice:
            raise ConstraintError("unique", f"{name}: two source rows for {key} {twice[0]['k']!r}")

        def action(matched: bool) -> Column:
            out = F.lit(-1)
            for i, b in reversed(list(enumerate(branches))):
                if b["matched"] == matched:
                    out = F.lit(i) if b["cond"] is None else F.when(b["cond"], F.lit(i)).otherwise(out)
            return out

        pairs = target.join(src, on, "inner")
        inside, touched, kept = self.touched(t, pairs.where(reduce(lambda a, i: a | (action(True) == i), [i for i, b in enumerate(branches) if b["matched"] and b["action"] != "nothing"], F.lit(False))))
        joined = inside.alias(alias).join(src.withColumn("_src", F.lit(1)).alias(source_alias), on, "left")
        act = F.when(F.col("_src").isNotNull(), action(True)).otherwise(F.lit(-1))
        outs = []
        for c in t["columns"]:
            col = F.col(f"`{alias}`.`{c['name']}`")
            for i, b in enumerate(branches):
                if b["action"] == "update" and c["name"] in b["sets"]:
                    col = F.when(act == i, b["sets"][c["name"]].cast(SPARK_TYPES[c["type"]])).otherwise(col)
            outs.append(col.alias(c["name"]))
        dropped = [i for i, b in enumerate(branches) if b["action"] == "delete"]
        updated = [i for i, b in enumerate(branches) if b["action"] == "update"]
        keep = ~act.isin(dropped) if dropped else F.lit(True)
        gone = inside.limit(0) if not dropped else joined.where(act.isin(dropped)).select(*(F.col(f"`{alias}`.`{c}`").alias(c) for c in inside.columns))
        n_gone = gone.count() if dropped else 0
        changed = joined.where(keep).select(*outs, (act.isin(updated) if updated else F.lit(False)).alias("_hit"))
        files = self.write(changed, name, ("_hit",)) if touched else []
        fresh = src.join(self.frame(name).alias(alias), on, "left_anti")
        inserts = self.store.frame(t, [])
        for i, b in enumerate(branches):
            if b["action"] == "insert":
                rows = fresh.where(action(False) == i).select(*(v.alias(c) for c, v in b["values"].items()))
                inserts = inserts.unionByName(self.complete(name, rows, default))
        fresh_files = self.write(inserts, name)
        new = self.store.frame(t, fresh_files)
        hits = self.hits(t, files)
        both = new.unionByName(hits)
        self.check_rows(name, both, check)
        self.check_unique(name, new, self.near(t, kept + files, fresh_files))
        self.put(name, kept + files + fresh_files)
        self.check_references(name, both)
        if n_gone:
            self.references_to(name, gone, check)
        old = joined.where(act.isin(updated)).select(*(F.col(f"`{alias}`.`{c}`").alias(c) for c in inside.columns)) if updated else inside.limit(0)
        return {"inserted": new, "old": old, "updated": hits, "deleted": gone, "count": new.count() + hits.count() + n_gone}

    def compact(self, name: str, rows: int = 1_000_000, most_bytes: int | None = None) -> int:
        """Rewrites small files, and those whose keys overlap with another's, into files of about so many rows, sorted by key, so that files and row
        groups can be skipped. Files that are large enough and apart stay as they are, so a table that grows at its end is never
        rewritten as a whole. With most_bytes, runs of files are taken until they have so many bytes: call again for the
        rest, each call is a commit of its own. Gives the files that were rewritten."""
        t = self.table(name)
        listed = self.store.files(t)
        known = [f for f in listed if f.get("rows") is not None and f.get("low") is not None]
        runs: list[list[dict]] = [[f] for f in listed if f not in known]
        high = None
        for f in sorted(known, key=lambda f: (f["low"], f["high"])):
            small = f["rows"] < rows // 2
            if high is not None and (f["low"] <= high or small and sum(x["rows"] for x in runs[-1]) < rows):
                runs[-1].append(f)
            else:
                runs.append([f])
            high = f["high"] if high is None else max(high, f["high"])
        todo, held = [], 0
        for run in (r for r in runs if len(r) > 1 or r[0].get("rows") is None or r[0]["rows"] > 2 * rows or r[0].get("gone")):
            if todo and most_bytes is not None and held + sum(f["bytes"] for f in run) > most_bytes:
                break
            todo += run
            held += sum(f["bytes"] for f in run)
        if not todo:
            return 0
        df = self.store.frame(t, todo)
        known_rows = [f.get("rows") for f in todo]
        n = max(1, -(-(df.count() if None in known_rows else sum(known_rows)) // rows))
        df = df.repartitionByRange(n, F.col(f"`{t['key']}`")).sortWithinPartitions(F.col(f"`{t['key']}`")) if t["key"] else df.repartition(n)
        taken = {f["path"] for f in todo}
        self.put(name, [f for f in listed if f["path"] not in taken] + self.write(df, name))
        return len(todo)
