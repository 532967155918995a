"""Spark-native knowledge-catalogue engine."""

from marquee.plans import catalogue, evidence, foundation, pipelines, texts, upserts  # noqa: F401
