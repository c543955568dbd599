"""Explicit table schemas and the fixed values of the source site."""

from pyspark.sql import types as T

# Fixed values of the source site: the category ids and the search address.
CATEGORY_IDS = list(range(1, 13))
CATEGORY_URL = "https://consultas.anvisa.gov.br/#/bulario/q/?categoriasRegulatorias=%s"

# Fixed column order of the catalog and of the crawl metadata.
CATALOG_COLUMNS = ["id", "page", "drug", "link", "company", "protocol", "pub_date"]
METADATA_COLUMNS = ["id", "items_page", "last_page", "size"]

# Total order of catalog rows: landing batch, category, page, row on the page.
SEQ_COLUMNS = ["batch", "id", "page", "pos"]

LISTING_PAGES = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("html", T.StringType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("drug", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("pub_date", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

# A chunk row is a catalog row plus the last page its listing announced.  A page
# without rows is kept as one row whose ``pos`` is NULL.
CHUNKS = T.StructType([*CATALOG.fields, T.StructField("last_page", T.IntegerType())])

METADATA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("items_page", T.IntegerType()),
        T.StructField("last_page", T.IntegerType()),
        T.StructField("size", T.LongType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("current_page", T.IntegerType()),
        T.StructField("last_page", T.IntegerType()),
        T.StructField("saved_size", T.IntegerType()),
    ]
)
