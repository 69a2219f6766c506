"""Lenses: an event as a token, at several granularities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of tools and shell commands under the coarse lens, fixed values.
TOOL_CLASSES = {
    "read": ("Read", "NotebookRead"), "search": ("Grep", "Glob", "WebSearch", "ToolSearch"), "edit": ("Edit", "Write", "NotebookEdit"), "agent": ("Task", "Agent"),
    "fetch": ("WebFetch",), "plan": ("TodoWrite", "ExitPlanMode", "EnterPlanMode"), "ask": ("AskUserQuestion",), "skill": ("Skill", "SlashCommand"),
}
SHELL_CLASSES = {
    "test": ("go_test", "npm_test", "vitest", "pytest"), "build": ("go_build", "make", "npm_run"), "lint": ("go_vet", "golangci-lint"),
    "search": ("rg", "grep", "fd", "find"), "read": ("cat", "bat", "head", "tail", "ls", "eza", "tree", "dtree", "wc", "jq"),
}


def _class_of(col: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    pairs = [F.lit(x) for name, members in classes.items() for m in members for x in (m, name)]
    return F.try_element_at(F.create_map(*pairs), col)


def _mcp(act: Column) -> Column:
    return act.startswith("mcp__")


def short_mcp(act: Column) -> Column:
    """mcp__server__tool as mcp:server.tool, mcp__server as mcp:server."""
    rest = F.substr(act, F.lit(6))
    at = F.instr(rest, "__")
    return F.concat(F.lit("mcp:"), F.when(at > 0, F.concat(F.substr(rest, F.lit(1), at - 1), F.lit("."), F.substr(rest, at + 2))).otherwise(rest))


def coarse() -> Column:
    act = F.col("act")
    vcs = act.isin("git", "gh") | act.startswith("git_") | act.startswith("gh_")
    tool = F.when(_mcp(act), "mcp").otherwise(F.coalesce(_class_of(act, TOOL_CLASSES), F.lit("tool")))
    shell = F.coalesce(_class_of(act, SHELL_CLASSES), F.when(vcs, "vcs").otherwise("sh"))
    return F.when(F.col("k") == "prompt", "prompt").when(F.col("k") == "tool", tool).when(F.col("k") == "shell", shell)


def tool() -> Column:
    act = F.col("act")
    return (
        F.when(F.col("k") == "prompt", "prompt")
        .when(F.col("k") == "tool", F.when(_mcp(act), short_mcp(act)).otherwise(act))
        .when(F.col("k") == "shell", F.concat(F.lit("sh:"), act))
    )


def target() -> Column:
    """The tool lens with the target's suffix, where it is one: at most eight
    bytes with the dot, without blank, slash or star."""
    suffix = F.regexp_extract("tgt", r"(\.[^./]*)\z", 1)
    fits = (F.col("k") == "tool") & (suffix != "") & (F.octet_length(suffix) <= 8) & ~suffix.rlike(r"[ /*]")
    return F.when(fits, F.concat(tool(), F.lit(":"), suffix)).otherwise(tool())


def exact() -> Column:
    """The tool lens with the whole target, or a shell command's text."""
    more = F.when(F.col("tgt") != "", F.col("tgt")).when((F.col("k") == "shell") & (F.col("d") != ""), F.col("d"))
    plain = F.col("k").isin("tool", "shell") & more.isNotNull()
    return F.when(plain, F.concat(tool(), F.lit(":"), more)).otherwise(tool())


LENSES: dict[str, Callable[[], Column]] = {"coarse": coarse, "tool": tool, "target": target, "exact": exact}


def lens(name: str) -> Column:
    """The token of an event; null for a kind that the lens doesn't see."""
    if name not in LENSES:
        raise ValueError(f"unknown lens {name!r}; there are {', '.join(sorted(LENSES))}")
    return LENSES[name]()


def marked(token: Column) -> Column:
    """! after a failed event's token, ? where a compound command failed."""
    mark = F.when(F.col("st") == "fail", "!").when(F.col("st") == "cfail", "?").otherwise("")
    return F.concat(token, mark)


def is_failed(token: Column) -> Column:
    return token.rlike(r"[!?]\+?\z")


def base_token(token: Column) -> Column:
    """Without the marks of runs and failures."""
    for mark in (r"\+\z", r"!\z", r"\?\z"):
        token = F.regexp_replace(token, mark, "")
    return token
