"""Gold kept up to date by change sets instead of rebuilt.

A change set names the keys whose source rows were added, changed or removed. They are carried on:
changed zips to the customers that live there, customers to their orders, items and payments to their
orders, orders to the reviews that name them, and review ids to everything that competes under them.
Only those keys are computed anew, from the source rows and stored summaries of these keys, and only
the hash partitions they lie in are rewritten.

Texts are stored once, beside gold: a key made of a review, its order and a digest of the text names a
text that never changes, so a change set adds the texts that are new and moves no other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators import silver
from punctual.operators.gold import GOLD_COLUMNS, gold_reviews
from punctual.sources.bronze import Bronze
from punctual.sources.cache import ResultCache, materialize
from punctual.sources.partitions import PARTITIONS, HashPartitions

#: Source table -> the column that names what changed in it.
KEYS = {
    "orders": "order_id",
    "order_reviews": "review_id",
    "order_items": "order_id",
    "order_payments": "order_id",
    "customers": "customer_id",
    "geolocation": "geolocation_zip_code_prefix",
}


def _of(frame: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``frame`` under ``keys``, a missing key included."""
    same = F.col(f"t.{column}").eqNullSafe(F.col(f"k.{column}"))
    return frame.alias("t").join(keys.select(column).alias("k"), same, "left_semi")


@dataclass(frozen=True)
class Changes:
    """Per source table a frame with the key column of ``KEYS``; ``None`` where nothing changed.

    A row that moves from one key to another is named under both.
    """

    orders: DataFrame | None = None
    order_reviews: DataFrame | None = None
    order_items: DataFrame | None = None
    order_payments: DataFrame | None = None
    customers: DataFrame | None = None
    geolocation: DataFrame | None = None

    def keys(self, table: str) -> DataFrame | None:
        frame = getattr(self, table)
        return None if frame is None else frame.select(KEYS[table]).distinct()


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The keys under which the rows of two states of a table differ: repeated rows count, their order does not.

    Each row is one hash in the comparison, so no wide row is shuffled, and the two halves of the hashes
    are added up per key where the rows are read. A digest of the texts that a source brings along
    stands for them, so that they are not read.
    """
    skipped = silver.TEXT_COLUMNS if "text_digest" in after.columns else ()
    parts = [c for name in sorted(after.columns) if name not in skipped for c in (F.col(name), F.col(name).isNull())]
    counted = [f.select(key, F.xxhash64(*parts).alias("_h"), F.lit(sign).alias("_n")) for f, sign in ((before, -1), (after, 1))]
    halves = F.col("_h").bitwiseAND(0xFFFFFFFF), F.shiftright("_h", 32)
    sums = [F.sum("_n").alias("_n"), *[F.sum(F.col("_n") * half).alias(f"_h{i}") for i, half in enumerate(halves)]]
    return counted[0].unionAll(counted[1]).groupBy(key).agg(*sums).where("_n <> 0 or _h0 <> 0 or _h1 <> 0").select(key)


class IncrementalGold:
    """Gold, its texts and the order summaries it needs, stored below ``root``.

    Gold without its texts and the summaries lie in hash partitions; ``_row`` leads from a gold row to
    its text and is missing where there is none.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int = PARTITIONS):
        self.spark, self.root = spark, root
        self.gold = HashPartitions(spark, root, "gold", "review_id", partitions)
        self.items = HashPartitions(spark, root, "order_items_agg", "order_id", partitions)
        self.payments = HashPartitions(spark, root, "order_payments_agg", "order_id", partitions)
        self.points = HashPartitions(spark, root, "zip_points", "zip_prefix", partitions)
        self.cache = ResultCache(spark, root)

    def create(self, bronze: Bronze) -> DataFrame:
        """Build all layers from the source tables."""
        self.items.create(silver.order_items_agg(bronze.order_items))
        self.payments.create(silver.order_payments_agg(bronze.order_payments))
        self.points.create(silver.zip_points(bronze.geolocation))
        self.cache.append("texts", self._texts(bronze.order_reviews))
        self.gold.create(self._gold(bronze, self.items.read(), self.payments.read(), self.points.read()))
        return self.read()

    def read(self) -> DataFrame:
        """Gold with its texts: the only time that all texts move. Rows without one are not joined."""
        narrow, texts = self.gold.read(), self._stored_texts()
        found = silver.one_text_per_row(texts)
        joined = narrow.where("_row is not null").join(found, "_row", "left").select(*GOLD_COLUMNS)
        bare = narrow.where("_row is null").withColumns({c: F.lit(None).cast(texts.schema[c].dataType) for c in silver.TEXT_COLUMNS})
        return joined.unionByName(bare.select(*GOLD_COLUMNS))

    @staticmethod
    def _texts(order_reviews: DataFrame) -> DataFrame:
        """(_row, texts) of the reviews that have one; a review without an order is in no gold."""
        present = " or ".join(f"{c} is not null" for c in silver.TEXT_COLUMNS)
        return silver.with_derived(order_reviews).where(f"order_id is not null and ({present})").select("_row", *silver.TEXT_COLUMNS)

    def _stored_texts(self) -> DataFrame:
        return self.cache.runs("texts", f"_row string, {', '.join(f'{c} string' for c in silver.TEXT_COLUMNS)}")

    def _add_texts(self, some_reviews: DataFrame, order_reviews: DataFrame) -> None:
        """Store the texts of ``some_reviews``, rows of ``order_reviews``, that are not stored yet."""
        rows = silver.with_derived(some_reviews).where(f"order_id is not null and {silver.HAS_ANY_TEXT}").select("_row")
        missing = materialize(rows.join(self._stored_texts().select("_row"), "_row", "left_anti").distinct(), f"{self.root}/work/texts")
        if not missing.isEmpty():
            self.cache.append("texts", self._texts(order_reviews).join(missing, "_row", "left_semi"))

    @staticmethod
    def _gold(some: Bronze, items: DataFrame, payments: DataFrame, points: DataFrame) -> DataFrame:
        """Gold rows without their texts."""
        clean = silver.orders_clean(some.orders)
        picked = silver.picked(some.order_reviews, clean, keep_digest=True)
        named = picked.withColumn("_row", F.when(F.expr(silver.HAS_ANY_TEXT), F.col("_row"))).drop("text_digest")
        return gold_reviews(named, clean, some.customers, items, payments, points)

    def _stored(self, name: str, keys: DataFrame) -> DataFrame:
        return materialize(keys.distinct(), f"{self.root}/work/{name}")

    def _affected_orders(self, bronze: Bronze, keys: dict[str, DataFrame]) -> DataFrame:
        """Orders of which a fact, a summary, the customer or the customer's place changed."""
        orders = [keys[t] for t in ("orders", "order_items", "order_payments") if t in keys]
        customers = [keys["customers"]] if "customers" in keys else []
        if "geolocation" in keys:
            zips = keys["geolocation"].withColumnRenamed(KEYS["geolocation"], "customer_zip_code_prefix")
            customers.append(_of(bronze.customers, zips, "customer_zip_code_prefix").select("customer_id"))
        # By the orders' own column, so that orders of a removed customer are found.
        orders += [bronze.orders.join(c, "customer_id", "left_semi").select("order_id") for c in customers]
        found = bronze.orders.select("order_id").limit(0)
        for some in orders:
            found = found.unionByName(some)
        return self._stored("orders", found)

    def _affected_reviews(self, bronze: Bronze, keys: dict[str, DataFrame], orders: DataFrame) -> DataFrame:
        """Changed review ids, and those with a row on an affected order: another row may win now."""
        found = bronze.order_reviews.join(orders, "order_id", "left_semi").select("review_id")
        return self._stored("reviews", found.unionByName(keys["order_reviews"]) if "order_reviews" in keys else found)

    def apply(self, bronze: Bronze, changes: Changes) -> dict[str, list[int]]:
        """Bring the layers to the state of ``bronze``, the source tables after ``changes``.

        Returns the partitions rewritten per layer. Applying a change set again changes nothing, so a
        call that broke off is simply repeated.
        """
        rewritten: dict[str, list[int]] = {}
        # Stored first: finding them may cost more than everything that reads them.
        keys = {t: self._stored(f"changed_{t}", k) for t in KEYS if (k := changes.keys(t)) is not None}
        for layer, table, build in (
            (self.items, "order_items", silver.order_items_agg),
            (self.payments, "order_payments", silver.order_payments_agg),
            (self.points, "geolocation", silver.zip_points),
        ):
            if table in keys:
                rows = build(_of(getattr(bronze, table), keys[table], KEYS[table]))
                rewritten[layer.name] = layer.replace(keys[table].withColumnRenamed(KEYS[table], layer.key), rows)
        orders = self._affected_orders(bronze, keys)
        reviews = self._affected_reviews(bronze, keys, orders)
        # What the affected reviews need of every table.
        some_reviews = _of(bronze.order_reviews, reviews, "review_id")
        named = self._stored("named_orders", some_reviews.select("order_id").where("order_id is not null"))
        some_orders = bronze.orders.join(named, "order_id", "left_semi")
        customers = bronze.customers.join(some_orders.select("customer_id"), "customer_id", "left_semi")
        some = replace(bronze, orders=some_orders, order_reviews=some_reviews, customers=customers)
        zips = self._stored("zips", customers.select(F.col("customer_zip_code_prefix").alias("zip_prefix")))
        if "order_reviews" in keys:
            self._add_texts(some_reviews, bronze.order_reviews)
        # Joined to the orders by key: only other partitions are left out, no row is moved for that.
        rows = self._gold(some, self.items.near(named), self.payments.near(named), self.points.near(zips))
        rewritten[self.gold.name] = self.gold.replace(reviews, rows)
        return rewritten
