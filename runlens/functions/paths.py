"""Column expressions over object and manifest paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed shapes.
BLOB_PATH = r"^blobs/([0-9a-f]{2})/([0-9a-f]{2})/([0-9a-f]{64})$"
MANIFEST_PATH = r"^manifests/(.+)\.json$"
JOB_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
SSH_KEY = r"^id_(rsa|dsa|ecdsa|ed25519)(_sk)?(\.pub)?$"
TEMPLATE_SUFFIXES = [".example", ".sample", ".template", ".dist"]


def blob_path(sha: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha)


def manifest_path(job: Column) -> Column:
    return F.concat(F.lit("manifests/"), job, F.lit(".json"))


def parse_object_path(path: Column) -> Column:
    """struct(kind, sha, job) of a canonical object path, NULL for anything else; the fan-out must match the sha."""
    sha = F.regexp_extract(path, BLOB_PATH, 3)
    fan = F.concat(F.regexp_extract(path, BLOB_PATH, 1), F.regexp_extract(path, BLOB_PATH, 2))
    job = F.regexp_extract(path, MANIFEST_PATH, 1)
    none = F.lit(None).cast("string")
    return (
        F.when((sha != "") & (F.substring(sha, 1, 4) == fan), F.struct(F.lit("blob").alias("kind"), sha.alias("sha"), none.alias("job")))
        .when(job.rlike(JOB_ID), F.struct(F.lit("manifest").alias("kind"), none.alias("sha"), job.alias("job")))
    )


def canonical_rel_path(path: Column) -> Column:
    bad = path.isNull() | (path == "") | F.contains(path, F.lit("\\")) | F.contains(path, F.lit("\x00"))
    return ~F.coalesce(bad | F.exists(F.split(path, "/", -1), lambda s: s.isin("", ".", "..")), F.lit(True))


def secret_shaped(path: Column) -> Column:
    base = F.element_at(F.split(path, "/", -1), -1)
    env = (base == ".env") | F.startswith(base, F.lit(".env."))
    template = F.lit(False)
    for s in TEMPLATE_SUFFIXES:
        template = template | F.endswith(base, F.lit(s))
    return F.when(env, ~template).otherwise(F.endswith(base, F.lit(".pem")) | base.rlike(SSH_KEY))
