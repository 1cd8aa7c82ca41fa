"""Tenants in one shared table: a mandatory filter, quotas, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import text as T


def checked(tenant_id: str) -> str:
    import re

    if not re.fullmatch(r"[0-9A-Za-z][-0-9A-Za-z_.]{0,63}", tenant_id) or ".." in tenant_id:
        raise ValueError(f"not a tenant id: {tenant_id!r}")
    return tenant_id


def scoped(chunks: DataFrame, tenant_id: str, keep: Column | None = None) -> DataFrame:
    """A tenant's own chunks; a further filter can't widen them. Where tenant_id is a partition column only its files are read."""
    own = chunks.filter(F.col("tenant_id") == checked(tenant_id))
    return own if keep is None else own.filter(keep)


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def over_quota(chunks: DataFrame, quotas: DataFrame) -> DataFrame:
    """Tenants with more documents than their quota; quotas(tenant_id, max_documents)."""
    return stats(chunks).join(quotas, "tenant_id").filter("documents > max_documents").select("tenant_id", "documents", "max_documents")


def erase(chunks: DataFrame, tenant_id: str) -> DataFrame:
    return chunks.filter(~F.col("tenant_id").eqNullSafe(checked(tenant_id)))


def valid(tenant_ids: Column) -> Column:
    return T.valid_tenant(tenant_ids)
