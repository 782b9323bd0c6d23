"""Planning an action from a sanitized observation: which region, which action; error codes that are safe to show.

Regions are rows (request, ord, region_id, type, text, interactable), so a page may have any number of them: what a
plan needs of them are minima by order, and these combine before the shuffle.  Missing text is empty, and a region
that doesn't say whether it's interactable is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = "r1"
_SIGN_IN, _SUBMIT = r"sign in|login", r"sign in|login|submit"


def _first(test: Column | None = None) -> Column:
    """The region of the smallest ordinal for which ``test`` holds; null where none does."""
    return F.min_by("region_id", "ord" if test is None else F.when(test, F.col("ord")))


def _regions(regions: DataFrame) -> DataFrame:
    return regions.withColumn("_t", F.lower(F.coalesce("text", F.lit("")))).withColumn("_on", F.coalesce("interactable", F.lit(True)))


def _with_tasks(tasks: DataFrame, regions: DataFrame, *aggregates: Column) -> DataFrame:
    return tasks.join(regions.groupBy("request").agg(*aggregates), "request", "left")


def plan(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """request, action, target: tasks (request, task) by the words of the task and the best button of the page.

    Buttons that sign in or submit come first, then any button, then links and controls that sign in, then the
    first region; all but the last must be interactable.
    """
    button = (F.col("type") == "button") & F.col("_on")
    link = F.col("type").isin("link", "custom_control") & F.col("_on") & F.col("_t").rlike(_SIGN_IN)
    own = _with_tasks(tasks, _regions(regions), *[
        _first(test).alias(name) for name, test in (("_a", button & F.col("_t").rlike(_SUBMIT)), ("_b", button), ("_c", link), ("_d", None))
    ])
    task = F.lower(F.coalesce("task", F.lit("")))
    action = F.when(task.contains("scroll"), "scroll").when(task.rlike("type|enter"), "type").otherwise("click")
    return own.select("request", action.alias("action"), F.coalesce("_a", "_b", "_c", "_d", F.lit(FIRST)).alias("target"))


def mock_plan(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """request, status, action, target, direction, text: deterministic plans for local pages, for when no planner answers."""
    own = _with_tasks(
        tasks, _regions(regions), _first(F.col("type").isin("input", "textarea")).alias("_input"),
        _first((F.col("type") == "button") | F.col("_t").rlike(_SIGN_IN)).alias("_button"), _first().alias("_first"),
    )
    task = F.lower(F.coalesce("task", F.lit("")))
    local = F.coalesce(F.col("origin").contains("localhost") | F.col("origin").contains("127.0.0.1"), F.lit(False))
    scroll = task.contains("scroll")
    fill = ~scroll & task.rlike("type|enter|fill")
    back = ~scroll & ~fill & task.contains("back")
    typed = fill & F.col("_input").isNotNull()
    action = F.when(scroll, "scroll").when(typed, "type").when(back, "back").otherwise("click")
    target = F.when(typed, F.col("_input")).when(~scroll & ~fill & ~back, F.coalesce("_button", "_first", F.lit(FIRST)))
    return own.select(
        "request", F.when(local, "action").otherwise("fail").alias("status"), F.when(local, action).alias("action"), F.when(local, target).alias("target"),
        F.when(local & scroll, F.when(task.contains("up"), "up").otherwise("down")).alias("direction"), F.when(local & typed, "mock input").alias("text"),
    )


#: Fixed: how an instruction names what to type and where, and what to click.
_TYPE, _SEARCH = r"type\s+['\"]?([^'\"]+)['\"]?\s+into\s+(.+)", r"search for\s+['\"]?([^'\"]+)['\"]?"
_CLICK, _OPEN = r"click\s+(?:the\s+)?(.+)", r"open\s+(?:the\s+)?(.+)"


def local_intent(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """request, action, target, direction, text: tasks (request, task, succeeded) parsed without a planner.

    In order: waiting that has succeeded is done; scrolling; going back; typing or searching, where a field or a
    region with the hint's text is there; clicking on the hint, else on anything interactable; then the first
    interactable button or the first region; a page without regions is done.
    """
    task = F.lower(F.coalesce("task", F.lit("")))
    is_type, is_search, is_click = task.rlike(_TYPE), task.rlike(_SEARCH), task.rlike(_CLICK)
    hint = F.when(is_type, F.regexp_extract(task, _TYPE, 2)).otherwise("search")
    aim = F.when(is_click, F.regexp_extract(task, _CLICK, 1)).otherwise(F.regexp_extract(task, _OPEN, 1))
    own = tasks.select(
        "request", task.alias("_task"), F.coalesce("succeeded", F.lit(False)).alias("_ok"), hint.alias("_hint"), F.trim(F.regexp_replace(aim, "button|link", "")).alias("_aim"),
        F.when(is_type, F.regexp_extract(task, _TYPE, 1)).when(is_search, F.regexp_extract(task, _SEARCH, 1)).alias("_typed"), (is_click | task.rlike(_OPEN)).alias("_click"),
    )
    named = lambda c: (F.coalesce("text", F.lit("")) != "") & F.col("_t").contains(F.col(c))
    on = F.coalesce("interactable", F.lit(False))
    met = _regions(regions).join(own.select("request", "_hint", "_aim"), "request").groupBy("request").agg(
        _first(on & (F.col("type").isin("input", "textarea") | named("_hint"))).alias("_field"), _first(on & named("_aim")).alias("_aimed"),
        _first(on).alias("_any"), _first(on & (F.col("type") == "button")).alias("_button"), _first().alias("_first"),
    )
    out = own.join(met, "request", "left")
    scroll = F.col("_task").contains("scroll")
    done = (F.col("_task").contains("wait") & F.col("_ok")) | (~scroll & ~F.col("_task").contains("go back") & F.col("_first").isNull())
    back = F.col("_task").contains("go back")
    typed = F.col("_typed").isNotNull() & F.col("_field").isNotNull()
    aimed = F.when(F.col("_click"), F.coalesce("_aimed", "_any"))
    action = F.when(done, "done").when(scroll, "scroll").when(back, "back").when(typed, "type").otherwise("click")
    target = F.when(action == "type", F.col("_field")).when(action == "click", F.coalesce(aimed, "_button", "_first"))
    return out.select(
        "request", action.alias("action"), target.alias("target"),
        F.when(action == "scroll", F.when(F.col("_task").contains("up"), "up").otherwise("down")).alias("direction"), F.when(action == "type", F.col("_typed")).alias("text"),
    )


#: A planner is any function of tasks and regions that gives a row per request; callers may add their own.
Provider = Callable[[DataFrame, DataFrame], DataFrame]
PROVIDERS: dict[str, Provider] = {"rules": plan, "mock": mock_plan, "local": local_intent}


def planned(provider: str | Provider, tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """The plans of a provider, which sees of the regions what an agent may see and nothing else."""
    run = PROVIDERS[provider] if isinstance(provider, str) else provider
    return run(tasks, observation(regions))


def observation(regions: DataFrame) -> DataFrame:
    """What an agent may see of regions: no boxes, no raw attributes."""
    return regions.select("request", "ord", "region_id", "type", "text", "interactable")


def outcome(result: Column) -> Column:
    """A past action's result as an agent sees it."""
    return F.when(result == "ok", "success").otherwise("failed")


#: Fixed: internal messages, the code and the message that go out instead, in order.
ERRORS: tuple[tuple[str, str, str], ...] = (
    ("requires a target element", "TARGET_NOT_FOUND", "The requested action requires a target region that was not found or provided."),
    ("requires a url", "INTERNAL", "The requested navigation action requires a valid URL."),
    ("Unsupported action type", "INTERNAL", "The requested action type is not supported."),
    ("fill_secret requires a resolved secret", "INTERNAL", "The secret could not be resolved for filling."),
)


def safe_error(message: Column) -> Column:
    """struct<code, message> without anything of the internal message."""
    code, text = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for part, own, shown in ERRORS:
        code, text = code.when(message.contains(part), own), text.when(message.contains(part), shown)
    return F.struct(code.otherwise("INTERNAL").alias("code"), text.otherwise("Action execution failed due to an internal browser error.").alias("message"))
