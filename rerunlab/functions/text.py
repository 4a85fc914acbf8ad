"""Scalar functions over message texts and names; all expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and must be as they are.
COMMAND = r"```(?:bash|sh)?\s*\n?\s*([A-Za-z_][\w\-.]*)"
AGENT_COMMANDS = (
    "open", "goto", "scroll_down", "scroll_up", "create", "edit", "insert", "append",
    "search_dir", "search_file", "find_file", "submit", "python", "python3", "pytest",
    "ls", "cd", "cat", "grep", "find", "git", "pip", "echo", "rm", "mv", "cp", "mkdir",
    "touch", "chmod", "which", "head", "tail", "sed", "awk", "diff", "make", "bash",
)
SHELL_COMMANDS = (
    "cd", "cat", "sed", "grep", "python", "python3", "find", "echo", "ls", "awk", "head", "tail",
    "git", "pytest", "mkdir", "touch", "rm", "mv", "cp", "chmod", "which", "diff", "make", "pip",
)
ERROR_LONG = "traceback|error|not found|no such file|command not found|failed|exception|invalid|denied"
ERROR_JSON = "error|failed|not found|cannot|unable|exception|denied"
ERROR_SHORT = "traceback|error|not found|failed|exception|denied"
ERROR_WORDS = ("error", "traceback", "exception", "failed", "not found", "no such file")
FAMILIES = ("qwen", "glm", "minimax", "kimi", "deepseek", "mimo", "opus", "gpt")
WEIGHTLESS_NUMBERS = ("0", "1", "2", "3", "4", "5", "10", "100", "0.5", "1.0", "0.05", "95", "2026", "2027", "12", "16", "50")
NUMBER = r"(?<![\w.])(\d{1,3}(?:[,{}]?\d{3})*(?:\.\d+)?|\d+\.\d+)(?![\w])"
# End of the fixed values.

SPACE = r"\s+"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def command(text: Column) -> Column:
    """The first word of the first fenced block, lower-cased; ``no_command`` without one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "(?U)" + COMMAND, 1)
    return F.when(found == "", "no_command").otherwise(F.lower(found))


def bucket(word: Column, vocabulary: tuple[str, ...] = AGENT_COMMANDS) -> Column:
    """Words outside the vocabulary become ``other_cmd``."""
    return F.when(word.isin(*vocabulary, "no_command"), word).otherwise("other_cmd")


def error_flag(text: Column, pattern: str = ERROR_LONG) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}").cast("int")


def error_count(text: Column, words: tuple[str, ...] = ERROR_WORDS) -> Column:
    """Occurrences of the words, without overlap, summed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return total


def any_error(text: Column, words: tuple[str, ...] = ERROR_WORDS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def first_token(text: Column, basename: bool = False) -> Column:
    word = F.lower(F.split(stripped(text), SPACE)[0])
    return F.substring_index(word, "/", -1) if basename else word


def tool_name(calls: Column) -> Column:
    """Name of the first call, by either layout; ``no_tool`` without one."""
    first = F.get(calls, F.lit(0))
    return F.coalesce(first["function"]["name"], first["name"], F.lit("no_tool"))


def last_block(text: Column) -> Column:
    """Body of the last fenced block, without its language line."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```[a-z]*\n(.*?)```"), 1)
    return F.try_element_at(blocks, F.lit(-1))


def prose(text: Column) -> Column:
    """What stands before the first fence."""
    return stripped(F.substring_index(text, "```", 1))


def head_and_rest(text: Column) -> tuple[Column, Column]:
    parts = F.split(stripped(text), SPACE, 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def role(name: Column) -> Column:
    """agent, environment or other."""
    return F.when(name.isin("ai", "assistant"), "agent").when(name.isin("user", "tool", "observation"), "environment").otherwise("other")


def tokens(text: Column) -> Column:
    """A quarter of the code points."""
    return F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)


def as_list(value: Column) -> Column:
    """A JSON list, or one value as a list; nothing as an empty one."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull() | (F.trim(value) == ""), F.array().cast("array<string>")).otherwise(F.when(F.startswith(F.trim(value), F.lit("[")) & listed.isNotNull(), listed).otherwise(F.array(value)))


def family(name: Column) -> Column:
    low = F.lower(name)
    out = F.substring_index(low, "-", 1)
    for f in reversed(FAMILIES):
        out = F.when(F.startswith(low, F.lit(f)), f).otherwise(out)
    return out


def numbers(text: Column) -> Column:
    """Numerals that carry evidence."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 1)
    return F.filter(found, lambda x: ~x.isin(*WEIGHTLESS_NUMBERS))


def number_variants(token: Column) -> Column:
    """The ways a numeral may be written elsewhere."""
    raw = F.regexp_replace(token, "[,{}]", "")
    value = F.try_to_number(raw, F.lit("999999999999.999999")).cast("double")
    dotted = F.contains(raw, F.lit("."))
    fixed = F.array(F.format_string("%.4f", value), F.format_string("%.3f", value), F.format_string("%.2f", value), F.regexp_replace(raw, "0+$", ""))
    whole = F.array(F.format_number(value, 0))
    return F.array_distinct(F.concat(F.array(raw, token), F.when(dotted, fixed).otherwise(whole)))
