"""Import of every operator module, which registers its query."""

from sentryspark.llm import (  # noqa: F401
    compression, decontamination, language_id, lexical_search, mixing, packing, personal_data,
    pitman_yor, quality, resampling, simhash, token_files, url_filters,
)
from sentryspark.llm.common import ORACLES, QUERIES  # noqa: F401
