"""From raw documents to packed training sequences; see marquee/llm/pipeline.py."""

from marquee.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
