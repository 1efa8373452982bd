"""From raw documents to a training mix: the stages of the library's pipeline, where the driver looks for them."""

from loomfield.llm.pipeline import ORACLE_SQL, STAGES, benchmark_decontamination, near_duplicates, personal_data, quality_rules, run, source_mix  # noqa: F401
