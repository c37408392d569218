"""The baking job: curated splits to training rows with schema context."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sqlcorpus import schemas as S
from sqlcorpus.operators.catalog import number_samples, render_schema_with_rows
from sqlcorpus.operators.prompts import bake
from sqlcorpus.session import Workspace
from sqlcorpus.sources.writers import write_baked


def prompt_contexts(catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """Schema texts with three, one and no sample rows, once a database."""
    return render_schema_with_rows(catalog, samples, S.SAMPLE_ROW_VARIANTS)


def run_bake(
    workspace: Workspace, curated: DataFrame, catalog: DataFrame, samples: DataFrame, template: str, path: str
) -> None:
    """Store ``prompt, completion, db_id, teacher_sql`` by split.

    ``samples`` are rows by table number, or by table name as ``sample_databases`` reads them.

    The schema texts are stored first: each is built once, their size decides whether the join
    broadcasts them, and if not, a database that holds much of the corpus can still be split.
    """
    if "table_name" in samples.columns:
        samples = number_samples(samples, catalog)
    contexts = workspace.table(render_schema_with_rows(catalog, samples, [3]), "contexts")
    write_baked(bake(curated, contexts, template), path)
