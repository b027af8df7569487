"""Tools as DataFrame functions with a description row each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators.headers import subset_of

TOOL_SCHEMA = "name STRING, description STRING, required ARRAY<STRING>, tasks ARRAY<STRING>, available BOOLEAN"


class Tool(NamedTuple):
    """A named transformation: use it with ``df.transform(tool.run)``."""

    name: str
    description: str
    required: Sequence[str]
    tasks: Sequence[str]
    run: Callable[..., DataFrame]
    available: bool = True


class SceneProvider(Protocol):
    """Where scenes come from: search gives scene rows, pixels gives the pixel table of a product."""

    def search(self, spark: SparkSession, **filters) -> DataFrame: ...

    def pixels(self, spark: SparkSession, product_ids: DataFrame) -> DataFrame: ...


class Toolbox:
    """Tools by name; a later registration of the same name replaces the earlier one."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> Tool:
        self._tools[tool.name] = tool
        return tool

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def names(self) -> list[str]:
        return list(self._tools)

    def table(self, spark: SparkSession) -> DataFrame:
        """Description rows, one per tool."""
        rows = [(t.name, t.description, list(t.required), list(t.tasks), t.available) for t in self._tools.values()]
        return spark.createDataFrame(rows, TOOL_SCHEMA)


def usable(task: str | Column, inputs: str | Column) -> Column:
    """A tool row serves a task and all inputs it requires are there."""
    wanted = F.col(task) if isinstance(task, str) else task
    return F.array_contains("tasks", wanted) & subset_of("required", inputs) & F.col("available")


def tools_for(requests: DataFrame, tools: DataFrame, task: str = "task", inputs: str = "inputs") -> DataFrame:
    """(request, tool) rows: an equi-join on the task, then the subset test."""
    by_task = tools.select("name", "required", "tasks", "available", F.explode("tasks").alias(task))
    return requests.join(by_task, task).filter(usable(task, inputs)).select(*requests.columns, F.col("name").alias("tool"))


def default_toolbox() -> Toolbox:
    """The built-in tools."""
    from scenelake.operators import query_text, regions, stats
    from scenelake.plans import change_job, fusion_job

    box = Toolbox()
    box.register(Tool("SpectralAnalysis", "Index statistics per scene", ["image"], ["GENERAL_ANALYSIS", "TEMPORAL_CHANGE"], stats.index_stats))
    box.register(Tool("ChangeDetection", "Change classes between two dates", ["image_a", "image_b"], ["TEMPORAL_CHANGE"], change_job.detect_change))
    box.register(Tool("OpticalSAR", "Optical and radar evidence", ["optical", "sar"], ["OPTICAL_SAR"], fusion_job.fuse))
    box.register(Tool("Grounding", "Boxes of a target", ["image"], ["GROUNDING", "MULTI_TOOL"], regions.target_regions))
    box.register(Tool("Captioning", "Land-cover sentence", ["image"], ["SINGLE_CAPTION"], stats.scene_caption))
    box.register(Tool("StatisticsAnswer", "Answer from statistics", ["image"], ["SINGLE_VQA", "GENERAL_ANALYSIS", "MULTI_TOOL"], query_text.describe_stats))
    return box
