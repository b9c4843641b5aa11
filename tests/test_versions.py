"""A stream keeps the findings of each file's newest version alone."""

from auditgrid.config import Config
from auditgrid.sources.shared import shared_dir
from auditgrid.streaming import incremental

MD5 = "createHash('md5');"
CONFIG = Config(rules=("weak-hashing", "missing-auth"))
ROUTE = "export async function GET() { return 1; }\n"


def land(spark, at, rows):
    spark.createDataFrame(rows, incremental.LANDED_DDL).coalesce(1).write.mode("append").parquet(f"{at}/landing")
    incremental.audit_stream(incremental.file_stream(spark, f"{at}/landing"), f"{at}/found", f"{at}/state", CONFIG).awaitTermination()


def found(spark, out):
    return sorted((r.repo or "", r.relative_path, r.line, r.severity) for r in incremental.findings(spark, out).collect())


def test_files_that_land_again(spark):
    at = f"{shared_dir(spark)}/versions-test"
    guard = "import { clerkMiddleware } from 'x';\nexport default clerkMiddleware();\nexport const config = { matcher: ['/api'] };"
    land(spark, at, [(1, "r", "a.js", MD5, 1), (2, "r", "b.js", MD5, 1), (3, None, "a.js", MD5, None), (4, "r", "app/api/x/route.ts", ROUTE, 1), (5, "r", "middleware.ts", guard, 1)])
    assert found(spark, f"{at}/found") == [("", "a.js", 1, "warning"), ("r", "a.js", 1, "warning"), ("r", "app/api/x/route.ts", 1, "warning"), ("r", "b.js", 1, "warning")]
    land(spark, at, [(1, "r", "a.js", "clean();", 2), (5, "r", "middleware.ts", "export const none = 1;", 2)])
    assert found(spark, f"{at}/found") == [("", "a.js", 1, "warning"), ("r", "app/api/x/route.ts", 1, "critical"), ("r", "b.js", 1, "warning")]
    # One batch with two versions of a file, a late old version, a deletion, and a repetition of an equal version.
    land(spark, at, [(1, "r", "a.js", "\n\n" + MD5, 4), (1, "r", "a.js", MD5, 3), (2, "r", "b.js", "\n" + MD5, 0), (3, None, "a.js", "\n" + MD5, None), (4, "r", "app/api/x/route.ts", None, 2)])
    want = [("", "a.js", 2, "warning"), ("r", "a.js", 3, "warning"), ("r", "b.js", 1, "warning")]
    assert found(spark, f"{at}/found") == want
    incremental.compact(spark, f"{at}/found", f"{at}/small")
    assert found(spark, f"{at}/small") == want
    assert spark.read.parquet(f"{at}/small").count() == 3 < spark.read.parquet(f"{at}/found").count()
