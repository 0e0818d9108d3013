"""Column expressions over command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_]*=(.*)$"
SHELL_SYNTAX = r"&&|\|\||[;|<>`\n]|\$\("
ENV_PREFIX = r"^env(?: -[uC] \S+| -\S*| [A-Za-z_]\w*=\S*)*(?: |$)"
SHELL_PREFIX = r"^(?:sh|bash|zsh|dash) -l?c(?: |$)"
SHELL_FIRST = r"^(?:sh|bash|zsh|dash)(?: |$)"
WRAPPER_DEPTH = 4
FAMILY_TOKENS = 3


def _assigned(token: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(token, ASSIGNMENT, 1), "^[\"']|[\"']$", "")


def _volatile(value: Column) -> Column:
    stamp = value.rlike(r"^\d[\d\-._:TZ]*$") & (F.length(F.regexp_replace(value, r"\D", "")) >= 6)
    return value.rlike(r"^[0-9a-fA-F]{7,}$") | stamp


def _let(value: Column, body) -> Column:
    """`body` over a bound value, so a nested use does not copy its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unwrap(line: Column) -> Column:
    """Drops one leading `env` or `sh -c`; '' for a shell that runs anything but a -c string."""
    return (
        F.when(line.rlike("^env(?: |$)"), F.regexp_replace(line, ENV_PREFIX, ""))
        .when(line.rlike(SHELL_PREFIX), F.regexp_replace(line, SHELL_PREFIX, ""))
        .when(line.rlike(SHELL_FIRST), F.lit(""))
        .otherwise(line)
    )


def _words(command: Column) -> Column:
    return F.filter(F.split(command, r"\s+"), lambda t: t != "")


def pairing_command(command: Column) -> Column:
    """The command without per-run assignments (shas, ids, timestamps) and without an `env` left bare by that."""
    kept = F.filter(_words(command), lambda t: ~_volatile(_assigned(t)))
    return _let(kept, _drop_bare_env)


def _drop_bare_env(kept: Column) -> Column:
    second = F.get(kept, F.lit(1))
    bare = (F.get(kept, F.lit(0)) == "env") & second.isNotNull() & ~F.startswith(second, F.lit("-")) & ~second.rlike(ASSIGNMENT)
    return F.array_join(F.when(F.coalesce(bare, F.lit(False)), F.slice(kept, F.lit(2), F.size(kept))).otherwise(kept), " ")


def command_family(command: Column) -> Column:
    """First words of the command behind `env` and `sh -c` wrappers; '' where no family can be named."""
    text = F.coalesce(command, F.lit(""))
    line = F.array_join(F.transform(_words(text), lambda t: F.regexp_replace(t, "^['\"]+|['\"]+$", "")), " ")
    for _ in range(WRAPPER_DEPTH):
        line = _let(line, _unwrap)
    return _let(line, lambda x: F.when(text.rlike(SHELL_SYNTAX), F.lit("")).otherwise(_family(x)))


def _family(line: Column) -> Column:
    words = F.filter(
        F.split(line, " "),
        lambda t: (t != "") & ~t.rlike(r"^[A-Za-z_]\w*=") & ~F.startswith(t, F.lit("-")) & ~t.rlike(r"[/.]"),
    )
    wrapped = line.rlike("^env(?: |$)") | line.rlike(SHELL_FIRST)
    return F.when(wrapped, F.lit("")).otherwise(F.array_join(F.slice(words, 1, FAMILY_TOKENS), " "))


def stable_assignments(command: Column) -> Column:
    """array<struct(name, value)> of the assignments whose value is not a per-run one."""
    pairs = F.transform(
        F.filter(_words(F.coalesce(command, F.lit(""))), lambda t: t.rlike(ASSIGNMENT)),
        lambda t: F.struct(F.regexp_extract(t, "^([^=]*)=", 1).alias("name"), _assigned(t).alias("value")))
    return F.filter(pairs, lambda p: ~_volatile(p["value"]))


def class_key(assignments: Column, names: Column) -> Column:
    """Sorted `NAME=value` of the assignments whose name is kept; NULL when none is."""
    kept = F.filter(assignments, lambda p: F.array_contains(names, p["name"]))
    texts = F.array_sort(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])))
    return F.when(F.size(texts) > 0, F.array_join(texts, " "))


def _replace_prefix(value: Column, prefix: Column, token: str) -> Column:
    flag = F.startswith(value, F.lit("-")) & F.contains(value, F.lit("="))
    at = F.when(flag, F.instr(value, "=")).otherwise(F.lit(0))
    head = F.substring(value, F.lit(1), at)
    rest = F.substring(value, at + 1, F.length(value))
    boundary = (F.length(rest) == F.length(prefix)) | (F.substring(rest, F.length(prefix) + 1, F.lit(1)) == "/")
    hit = F.startswith(rest, prefix) & boundary & (F.coalesce(F.length(prefix), F.lit(0)) > 0)
    tail = F.substring(rest, F.length(prefix) + 1, F.length(value))
    return F.when(F.coalesce(hit, F.lit(False)), F.concat(head, F.lit(token), tail)).otherwise(value)


def argv_fingerprint(argv: Column, root: Column, tmp: Column, cwd: Column) -> Column:
    """sha256 of the JSON of the working directory and argv with this run's checkout and temp folder rewritten."""
    tmp = F.regexp_replace(tmp, "/+$", "")

    def norm(x: Column) -> Column:
        return _let(_replace_prefix(x, root, "<repo>"), lambda y: _replace_prefix(y, tmp, "<tmp>"))

    body = F.to_json(F.struct(norm(cwd).alias("cwd"), F.transform(argv, norm).alias("argv")))
    usable = (F.size(argv) > 0) & ~F.exists(argv, lambda a: a.isNull())
    return F.when(usable, F.sha2(body, 256))
