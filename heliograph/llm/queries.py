"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = (
    "substring_dedup",
    "minhash",
    "toxicity",
    "bpe",
    "mixing",
    "language_id",
    "ann",
    "topk",
    "url_filter",
    "license_scan",
)


def queries() -> dict:
    out = {}
    for m in MODULES:
        module = importlib.import_module(f"heliograph.llm.{m}")
        out |= {k: v for k, v in vars(module).items() if k.startswith("op") and callable(v)}
    return dict(sorted(out.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        module = importlib.import_module(f"heliograph.llm.{m}")
        name = next(k for k, v in vars(module).items() if k.startswith("op") and callable(v))
        if getattr(module, "ORACLE", None):
            out[name] = module.ORACLE
    return out
