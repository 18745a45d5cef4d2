"""Print the formatted physical plans of the headline stages (no execution)."""
import sys

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from harrow.config import TEST  # noqa: E402
from harrow.operators.content import page_content  # noqa: E402
from harrow.operators.dedupe import assign_groups  # noqa: E402
from harrow.operators.scoring import score_columns  # noqa: E402
from harrow.plans.derived import derived_targets  # noqa: E402
from harrow.session import local_session  # noqa: E402
from harrow.sources.pages import pages_normalised  # noqa: E402
from harrow.sources.targets import target_domains  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = local_session()
pages = spark.read.parquet(f"{sf}/pages.parquet")
docs = spark.read.parquet(f"{sf}/documents.parquet")
print("=== parse + score, in-scope pages ===")
score_columns(page_content(pages_normalised(pages, target_domains(derived_targets(pages)))), TEST).explain("formatted")
print("=== near-duplicate clustering (documents) ===")
rows = docs.select(F.col("doc_id").alias("row_idx"), F.substring("text", 1, 60).alias("name"),
                   F.concat(F.lit("https://"), F.col("source")).alias("url"))
assign_groups(rows, 0.88).explain("formatted")
