"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .embeddings import SQL as EMBEDDINGS_SQL
from .embeddings import op4_embeddings
from .fingerprints import op1_fingerprints
from .merkle import SQL as MERKLE_SQL
from .merkle import op13_merkle
from .mixing import op9_mixing
from .packing import op5_packing
from .quality import op7_quality
from .secrets import SQL as SECRETS_SQL
from .secrets import op6_secrets
from .sharding import op11_sharding
from .simhash import op8_simhash
from .substring_dedup import SQL as SUBSTRING_SQL
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import SQL as SUFFIX_SQL
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_embeddings": op4_embeddings,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = {"op2_substring_dedup": SUBSTRING_SQL, "op3_suffix_dedup": SUFFIX_SQL, "op4_embeddings": EMBEDDINGS_SQL, "op6_secrets": SECRETS_SQL, "op13_merkle": MERKLE_SQL}
