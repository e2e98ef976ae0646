"""Stored tables that are changed by key, and a cache of computed vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.profiles import chunk_key
from tracequarry.sources.store import Generations, discard, exists, written

#: Parts that keys are dealt to by hash; a change rewrites the parts of its keys and no others.
PARTS = 64


class KeyedTable:
    """Rows with unique keys, in PARTS folders. A change writes new folders for the parts it touches, and one append to the commits makes
    them count, all at once: a failed change leaves the table as it was. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], parts: int = PARTS):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def _folders(self) -> dict[int, str]:
        """The current folder of each part; a row a part and change."""
        if not exists(self.spark, f"{self.path}/commits"):
            return {}
        rows = self.spark.read.schema("number int, part int, folder string").json(f"{self.path}/commits").collect()
        return {r.part: r.folder for r in sorted(rows, key=lambda r: r.number)}

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        folders = [f for p, f in self._folders().items() if only is None or p in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def change(self, rows: DataFrame) -> None:
        """Puts rows in the place of those with their keys; rows with gone = true only take those away. A key comes once."""
        new = written(rows.select(*self.columns, F.coalesce("gone", F.lit(False)).alias("gone"), self.part().alias("part")), "change")
        touched = [r.part for r in new.select("part").distinct().collect()]  # PARTS at most
        if not touched:
            return
        known = self._folders()
        number = (max(int(f.split("-")[0]) for f in known.values()) + 1) if known else 0
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        kept = self.read(touched).alias("o").join(new.alias("n"), same, "left_anti").withColumn("part", self.part())
        after = kept.unionByName(new.where("not gone").drop("gone"))
        folder = f"{number}-{Generations(self.spark, self.path).begin()}"
        after.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        filled = {r.part for r in after.select("part").distinct().collect()}
        for empty in set(touched) - filled:  # a part that lost all its rows is an empty folder with the table's columns
            self.spark.createDataFrame([], self.schema).write.parquet(f"{self.path}/{folder}/part={empty}")
        discard(new)
        rows = self.spark.createDataFrame([(number, p, f"{folder}/part={p}") for p in touched], "number int, part int, folder string")
        rows.coalesce(1).write.mode("append").json(f"{self.path}/commits")


# A note's key and length, notes of one project, tasks of one plan, their lengths, and what a task can be.
NOTE_KEY, NOTE_CHARS, NOTES, TASKS, TASK_CHARS, RESULT_CHARS = r"^[A-Za-z0-9_.\-/]{1,80}$", 8192, 100, 20, 160, 240
STATUSES = ("pending", "in_progress", "done", "skipped")


class Notes:
    """Notes of projects: project, key, value."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, "project string, key string, value string", ["project", "key"])

    def save(self, saves: DataFrame) -> DataFrame:
        """Saves project, key, value (null deletes), at; a key's last row counts. Gives project, key and error of what was refused.

        New keys are taken in the order of their rows, after the deletions, until their project has NOTES.
        """
        from pyspark.sql import Window

        last = saves.withColumn("key", F.trim("key")).groupBy("project", "key").agg(F.max(F.struct("at", "value")).alias("s")).select("project", "key", "s.at", "s.value")
        shape = F.when(~F.coalesce(F.col("key"), F.lit("")).rlike(NOTE_KEY), "invalid key").when(F.length("value") > NOTE_CHARS, "value too long")
        x = written(last.withColumn("error", shape), "saves")
        known = self.table.read().select("project", "key", F.lit(True).alias("known"))
        sound = x.where("error is null").join(known, ["project", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        left = known.join(sound.where("value is null").select("project", "key"), ["project", "key"], "left_anti").groupBy("project").agg(F.count("*").alias("n"))
        order = Window.partitionBy("project").orderBy("at", "key")
        fresh = sound.where("value is not null and not known").withColumn("k", F.row_number().over(order)).join(left, "project", "left")
        fresh = fresh.withColumn("error", F.when(F.col("k") + F.coalesce("n", F.lit(0)) > NOTES, f"more than {NOTES} keys"))
        old = sound.where("known")
        rows = old.select("project", "key", "value", F.col("value").isNull().alias("gone")).unionByName(fresh.where("error is null").select("project", "key", "value", F.lit(False).alias("gone")))
        refused = written(x.where("error is not null").select("project", "key", "error").unionByName(fresh.where("error is not null").select("project", "key", "error")), "refused")
        self.table.change(rows)
        return refused

    def listing(self) -> DataFrame:
        first = F.substring_index("value", "\n", 1)
        more = F.when((F.length("value") > 80) | F.col("value").contains("\n"), "...").otherwise("")
        return self.table.read().select("project", "key", F.length("value").cast("long").alias("chars"), F.concat(F.left(first, F.lit(80)), more).alias("shown"))


class Plans:
    """Tasks of plans: plan, idx (from 1), text, status, result."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, "plan string, idx int, text string, status string, result string", ["plan", "idx"])

    def create(self, plans: DataFrame) -> DataFrame:
        """Puts plans (plan, tasks array<string>) in the place of those of their names. Gives plan and error of what was refused."""
        trimmed = F.transform("tasks", lambda t: F.trim(F.coalesce(t, F.lit(""))))
        error = F.when(F.coalesce(F.size("tasks"), F.lit(0)) <= 0, "no tasks").when(F.size("tasks") > TASKS, f"more than {TASKS} tasks").when(F.exists(trimmed, lambda t: t == ""), "empty task")
        x = written(plans.select("plan", "tasks", trimmed.alias("clean"), error.alias("error")), "plans")
        new = x.where("error is null").select("plan", F.posexplode("clean").alias("k", "t")).select("plan", (F.col("k") + 1).alias("idx"), F.left("t", F.lit(TASK_CHARS)).alias("text"), F.lit("pending").alias("status"), F.lit("").alias("result"), F.lit(False).alias("gone"))
        old = self.table.read().join(x.where("error is null").select("plan"), "plan", "left_semi").withColumn("gone", F.lit(True)).join(new.select("plan", "idx"), ["plan", "idx"], "left_anti")
        self.table.change(new.unionByName(old.select(*new.columns)))
        return x.where("error is not null").select("plan", "error")

    def update(self, changes: DataFrame) -> DataFrame:
        """Sets status and result (where they aren't null or empty) of tasks (plan, idx, status, result). Gives plan, idx and error of what was refused."""
        x = changes.alias("c").join(self.table.read().alias("t"), ["plan", "idx"], "left")
        bad = F.when(F.col("t.text").isNull(), "no such task").when(F.coalesce(F.col("c.status"), F.lit("")) == "", None).when(~F.col("c.status").isin(*STATUSES), "no such status")
        told = lambda c: F.coalesce(F.nullif(F.col(f"c.{c}"), F.lit("")), F.col(f"t.{c}"))
        x = written(x.select("plan", "idx", F.col("t.text").alias("text"), told("status").alias("status"), F.left(F.trim(told("result")), F.lit(RESULT_CHARS)).alias("result"), bad.alias("error")), "tasks")
        self.table.change(x.where("error is null").drop("error").withColumn("gone", F.lit(False)))
        return x.where("error is not null").select("plan", "idx", "error")

    def extend(self, more: DataFrame) -> DataFrame:
        """Adds tasks (plan, tasks) behind the last ones; empty ones are passed over. Gives plan and error of what was refused."""
        have = self.table.read().groupBy("plan").agg(F.count("*").alias("n"), F.max("idx").alias("last"))
        error = F.when(F.col("n").isNull(), "no plan").when(F.col("n") + F.size("tasks") > TASKS, f"more than {TASKS} tasks")
        x = written(more.join(have, "plan", "left").withColumn("error", error), "more")
        new = x.where("error is null").select("plan", "last", F.posexplode("tasks").alias("k", "t")).where(F.trim("t") != "")
        self.table.change(new.select("plan", (F.col("last") + F.col("k") + 1).alias("idx"), F.left(F.trim("t"), F.lit(TASK_CHARS)).alias("text"), F.lit("pending").alias("status"), F.lit("").alias("result"), F.lit(False).alias("gone")))
        return x.where("error is not null").select("plan", "error")

    def counts(self) -> DataFrame:
        n = lambda s: F.count_if(F.col("status") == s).alias(s)
        return self.table.read().groupBy("plan").agg(*map(n, STATUSES), F.count("*").alias("total"))


VECTORS = "key string, vector array<float>"


class VectorCache:
    """Vectors of texts by model and text: only texts whose key isn't stored are computed, and appended."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.model, self.store = model, Generations(spark, path)

    def vectors(self, texts: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """texts (text, ...) with key and vector; compute gives key, vector of rows (key, text), each text once."""
        keyed = texts.withColumn("key", chunk_key(self.model, F.col("text")))
        known = self.store.read("vectors", VECTORS)
        # Equal texts are one row before anything is computed, so a text that a third of all rows have is no hot key.
        missed = written(keyed.groupBy("key").agg(F.first("text").alias("text")).where("text is not null").join(known.select("key"), "key", "left_anti"), "missed")
        if not missed.isEmpty():
            name = self.store.begin()
            self.store.write(compute(missed).select("key", F.col("vector").cast("array<float>").alias("vector")), name, "vectors")
            self.store.commit(name)
        discard(missed)
        stored = self.store.read("vectors", VECTORS)
        return keyed.join(stored.dropDuplicates(["key"]) if len(self.store.commits()) > 1 else stored, "key", "left")

    def compact(self) -> None:
        """One generation in the place of all, each key once: two writers may have computed the same text."""
        names = self.store.commits()
        if names:
            name = self.store.begin()
            self.store.write(self.store.read("vectors", VECTORS, names).dropDuplicates(["key"]), name, "vectors")
            self.store.commit(name, instead=True)
