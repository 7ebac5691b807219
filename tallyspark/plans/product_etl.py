"""Product snowflake ETL (M8): clean product, subcategory and category, then join.

The three cleans are lazy branches of one plan; the join keys are typed
(text -> double -> int) before joining.  The subcategory and category tables
are derived (distinct over the product source), so no up-front count is run
for them: AQE measures the shuffled distinct at runtime and broadcasts it
when it is small, else keeps a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.tables import tables

# Fixed values (data contract): the kept columns of the product source.
PRODUCT_COLUMNS = [
    "ProductKey", "ProductAlternateKey", "ProductSubcategoryKey", "WeightUnitMeasureCode", "SizeUnitMeasureCode",
    "EnglishProductName", "StandardCost", "FinishedGoodsFlag", "Color", "SafetyStockLevel", "ReorderPoint", "ListPrice",
    "Size", "SizeRange", "Weight", "DaysToManufacture", "ProductLine", "DealerPrice", "Class", "Style", "ModelName",
    "EnglishDescription", "StartDate", "EndDate", "Status",
]
# Fixed values (data contract): the columns with a NULL default; typed here (numbers stay numbers).
PRODUCT_DEFAULTS = {
    "WeightUnitMeasureCode": "0", "ProductSubcategoryKey": "0", "SizeUnitMeasureCode": "0",
    "StandardCost": 0.0, "ListPrice": 0.0, "DealerPrice": 0.0, "Weight": 0.0,
    "ProductLine": "NA", "Class": "NA", "Style": "NA", "Size": "NA", "ModelName": "NA", "EnglishDescription": "NA",
}
PRODUCT_RENAMES = {"EnglishDescription": "Description", "EnglishProductName": "ProductName"}


def _brand_no():
    return F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")


def type_keys(t: tables) -> DataFrame:
    """Category key per product type: rank of the type among the distinct types.

    The window runs over the distinct types only (a small, bounded domain).
    """
    types = t.part.select("p_type").distinct()
    return types.select("p_type", F.dense_rank().over(Window.orderBy("p_type")).alias("type_key"))


def src_product(t: tables) -> DataFrame:
    """Product source derived from ``part`` (with the gaps a real source has)."""
    p = t.part.join(type_keys(t), "p_type")
    sub_key = (_brand_no() * 100 + F.col("type_key")).cast("string")
    decade = F.floor(F.col("p_size") / 10).cast("int")
    started = F.date_add(F.lit("2010-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int"))
    ended = F.col("p_partkey") % 3 == 0
    return p.select(
        F.col("p_partkey").alias("ProductKey"),
        F.concat(F.lit("AK-"), F.col("p_partkey").cast("string")).alias("ProductAlternateKey"),
        F.when(F.col("p_type") != "PROMO", F.concat(sub_key, F.lit(".0"))).alias("ProductSubcategoryKey"),
        F.when(F.col("p_size") > 40, F.lit("LB")).alias("WeightUnitMeasureCode"),
        F.when(F.col("p_size") > 25, F.lit("CM")).alias("SizeUnitMeasureCode"),
        F.col("p_name").alias("EnglishProductName"),
        F.when(F.col("p_type") != "ECONOMY", F.round(F.col("p_retailprice") * 0.6, 2)).alias("StandardCost"),
        F.split("p_name", " ").getItem(0).alias("Color"),
        F.col("p_retailprice").alias("ListPrice"),
        F.when(F.col("p_size") <= 45, F.col("p_size").cast("string")).alias("Size"),
        F.when(F.col("p_size") >= 10, (F.col("p_size") * 1.5)).alias("Weight"),
        F.when(F.col("p_type").isin("LARGE", "SMALL"), F.substring("p_type", 1, 1)).alias("ProductLine"),
        F.when(F.col("p_size") >= 30, F.lit("H")).when(F.col("p_size") >= 10, F.lit("M")).alias("Class"),
        F.when(~F.col("p_name").contains("gear"), F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")))
        .alias("EnglishDescription"),
        F.col("p_size").alias("DaysToManufacture"),
        (F.col("p_size") % 2 == 0).alias("FinishedGoodsFlag"),
        (F.col("p_size") * 20).cast("int").alias("SafetyStockLevel"),
        (F.col("p_size") * 15).cast("int").alias("ReorderPoint"),
        F.when(F.col("p_size") <= 45, F.concat((decade * 10).cast("string"), F.lit("-"), (decade * 10 + 9).cast("string")))
        .alias("SizeRange"),
        F.when(F.col("p_type") != "STANDARD", F.round(F.col("p_retailprice") * 0.8, 2)).alias("DealerPrice"),
        F.when(F.col("p_type").isin("SMALL", "MEDIUM"), F.lit("U")).alias("Style"),
        F.when(F.col("p_size") > 5, F.split("p_name", " ").getItem(1)).alias("ModelName"),
        started.alias("StartDate"),
        F.when(ended, F.date_add(started, 365)).alias("EndDate"),
        F.when(~ended, F.lit("Current")).alias("Status"),
    )


def src_subcategory(t: tables) -> DataFrame:
    """Distinct (brand, type) pairs; each belongs to the category of its type."""
    pairs = t.part.select("p_brand", "p_type").distinct().join(type_keys(t), "p_type")
    key = _brand_no() * 100 + F.col("type_key")
    return pairs.select(
        key.alias("ProductSubcategoryKey"),
        F.concat_ws(" ", "p_brand", "p_type").alias("EnglishProductSubcategoryName"),
        (key * 10).alias("ProductSubcategoryAlternateKey"),
        F.col("type_key").alias("ProductCategoryKey"),
    )


def src_category(t: tables) -> DataFrame:
    """Distinct product types."""
    return type_keys(t).select(
        F.col("type_key").alias("ProductCategoryKey"), (F.col("type_key") * 100).alias("ProductCategoryAlternateKey"),
        F.col("p_type").alias("EnglishProductCategoryName"),
    )


def stg_product(src: DataFrame) -> DataFrame:
    """Clean products: kept columns, typed NULL defaults, renames."""
    df = src.select(*PRODUCT_COLUMNS).na.fill(PRODUCT_DEFAULTS)
    return df.withColumnsRenamed(PRODUCT_RENAMES)


def stg_subcategory(src: DataFrame) -> DataFrame:
    """Clean subcategories: kept columns, rename."""
    cols = ["ProductSubcategoryKey", "EnglishProductSubcategoryName", "ProductSubcategoryAlternateKey",
            "ProductCategoryKey"]
    return src.select(*cols).withColumnsRenamed({"EnglishProductSubcategoryName": "ProductSubcategoryName"})


def stg_category(src: DataFrame) -> DataFrame:
    """Clean categories: kept columns, rename."""
    return src.select("ProductCategoryKey", "ProductCategoryAlternateKey", "EnglishProductCategoryName") \
        .withColumnsRenamed({"EnglishProductCategoryName": "ProductCategoryName"})


def product_model(p: DataFrame, ps: DataFrame, pc: DataFrame, how: str = "inner") -> DataFrame:
    """Join the three cleaned tables; the text key goes text -> double -> int first."""
    p = p.withColumn("ProductSubcategoryKey", F.col("ProductSubcategoryKey").cast("double").cast("int"))
    return p.join(ps, "ProductSubcategoryKey", how).join(pc, "ProductCategoryKey", how)


def product_snowflake(t: tables) -> DataFrame:
    """Q32: the cleaned product snowflake."""
    return product_model(stg_product(src_product(t)), stg_subcategory(src_subcategory(t)),
                         stg_category(src_category(t)))
