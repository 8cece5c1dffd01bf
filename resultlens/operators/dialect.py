"""Rewriting SQLite spellings to Spark SQL, token by token, outside of string literals.

Beyond spelling, sessions that run such statements switch ANSI mode off (see SETTINGS): division by zero and failing casts then give null. `/` between integers truncates, a cast of text takes the number that
the text begins with (0 without one), GLOB becomes a pattern, and LIKE ignores case in sandbox mode only. Functions of time take modifiers (literals: lengths of time, `start of`, `weekday`), printf and format convert
their arguments as its directives ask. Text in arithmetic counts as the number that it begins with where it is a literal, and where `+ 0`, `- 0` or `* 1` asks for a number of an operand of any type. Numbers keep their
value, not always their type: a truncated quotient is a double, and so is an operand that may be text."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[A-Za-z_][^\]\n]*\]|[A-Za-z_]\w*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?D?|\.\d+(?:[eE][+-]?\d+)?D?|\s+|.""", re.DOTALL)
_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"
_NUMBER = {"INT": ("bigint", r"^\\s*([+-]?[0-9]+)"), "INTEGER": ("bigint", r"^\\s*([+-]?[0-9]+)"), "BIGINT": ("bigint", r"^\\s*([+-]?[0-9]+)"), "REAL": ("double", r"^\\s*([+-]?[0-9]*\\.?[0-9]+(?:[eE][+-]?[0-9]+)?)"), "FLOAT": ("double", r"^\\s*([+-]?[0-9]*\\.?[0-9]+(?:[eE][+-]?[0-9]+)?)")}
SETTINGS = {"spark.sql.ansi.enabled": "false"}
#: Functions that only have another name in Spark.
RENAMED = {"ifnull": "coalesce", "iif": "if", "total": "sum"}
#: Directives of strftime and their letters in date_format.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}
#: Directives that no letter of date_format stands for, as expressions over the moment.
COMPUTED = {"%w": "cast(dayofweek({0}) - 1 AS string)", "%s": "cast(unix_seconds({0}) AS string)", "%J": "cast(unix_micros({0}) / 86400000000D + 2440587.5D AS string)", "%%": "'%'"}
#: Formats of the functions of time that take none.
FORMATS = {"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S"}
_LENGTHS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_LENGTH = re.compile(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?")
_DIRECTIVE = re.compile(r"%([-+ 0,#]*)(\d*)((?:\.\d+)?)(?:l|ll)?([diufeEgGsxXoc%])")
#: Words that may stand before an operator and are no operand.
_NO_OPERAND = frozenset("AND OR NOT IN SELECT WHERE ON BY THEN ELSE WHEN HAVING CASE END BETWEEN LIKE ILIKE GLOB RLIKE IS AS DISTINCT LIMIT OFFSET FROM".split())
_ASKS_NUMBER = {"+": ("0", "0.0"), "-": ("0", "0.0"), "*": ("1", "1.0")}


def _arguments(tokens: list[str], at: int) -> tuple[list[str], int] | None:
    """Arguments of the call whose opening parenthesis is at `at`, rewritten, and where it ends."""
    depth, args, now = 0, [], []
    for k in range(at, len(tokens)):
        x = tokens[k]
        depth += (x == "(") - (x == ")")
        if depth == 0:
            return [*args, _rewritten(now).strip()], k
        if depth == 1 and x == ",":
            args.append(_rewritten(now).strip())
            now = []
        elif k > at:
            now.append(x)
    return None


def _rewritten(tokens: list[str]) -> str:
    out, k = [], 0
    while k < len(tokens):
        x = tokens[k]
        if x[0] == '"' and len(x) > 1:
            x = "`" + x[1:-1].replace('""', '"').replace("`", "``") + "`"
        elif x[0] == "[" and len(x) > 1:
            x = "`" + x[1:-1].replace("`", "``") + "`"
        elif x[0] == "'" and len(x) > 1:
            x = x.replace("\\", "\\\\")
        elif x.upper() == "GLOB" and (at := _next(tokens, k)) < len(tokens) and tokens[at][0] == "'":
            x, k = f"RLIKE {_glob(tokens[at][1:-1])}", at
        elif x.upper() == "CAST" and tokens[k + 1 : k + 2] == ["("] and (cast := _cast(tokens, k + 1)):
            x, k = cast
        elif x.lower() in ("date", "time", "datetime", "julianday", "strftime") and tokens[k + 1 : k + 2] == ["("] and (found := _arguments(tokens, k + 1)) and (text := _time(x.lower(), found[0])):
            x, k = text, found[1]
        elif x.lower() == "group_concat" and tokens[k + 1 : k + 2] == ["("] and (found := _arguments(tokens, k + 1)):
            args, k = found
            x = f"listagg({', '.join(args if len(args) > 1 else [*args, chr(39) + ',' + chr(39)])})"
        elif x.lower() in ("printf", "format") and tokens[k + 1 : k + 2] == ["("] and (found := _arguments(tokens, k + 1)) and (text := _printf(found[0])):
            x, k = text, found[1]
        elif x[0] in ".0123456789" and not x.isdigit() and x != "." and x[-1] != "D":
            x += "D"  # a double, as with SQLite
        elif tokens[_next(tokens, k) : _next(tokens, k) + 1] == ["("]:
            x = RENAMED.get(x.lower(), x)
        out.append(x)
        k += 1
    return "".join(out)


def _literal(text: str) -> str | None:
    """What a string literal of a rewritten statement holds; None for anything else."""
    return text[1:-1].replace("''", "'").replace("\\\\", "\\") if re.fullmatch(r"'(?:[^']|'')*'", text) else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def _moment(args: list[str]) -> str | None:
    """A moment with its modifiers applied from left to right; None where one of them is not known. A month or a year more keeps the day's number, and what is beyond the month's end runs into the next."""
    if not args or not args[0]:
        return "current_timestamp()"
    moment, args = "current_timestamp()" if args[0].lower() == "'now'" else f"cast({args[0]} AS timestamp)", args[1:]
    if args and args[0].lower() == "'unixepoch'":
        moment, args = moment.replace("cast(", "timestamp_micros(cast(1000000 * cast(", 1).replace(" AS timestamp)", " AS double) AS bigint))"), args[1:]
    for modifier in map(_literal, args):
        if modifier is None:
            return None
        modifier = " ".join(modifier.lower().split())
        if m := _LENGTH.fullmatch(modifier):
            if m[2] in _LENGTHS:
                moment = f"timestamp_micros(unix_micros({moment}) + {round(float(m[1]) * _LENGTHS[m[2]] * 1e6)}L)"
            elif "." in m[1]:
                return None
            else:
                months = int(m[1]) * (12 if m[2] == "year" else 1)
                first = f"date_trunc('MONTH', {moment})"
                moment = f"timestamp_micros(unix_micros({moment}) - unix_micros({first}) + unix_micros(timestampadd(MONTH, {months}, {first})))"
        elif modifier in ("start of day", "start of month", "start of year"):
            moment = f"date_trunc('{modifier.split()[-1].upper()}', {moment})"
        elif re.fullmatch("weekday [0-6]", modifier):
            moment = f"timestampadd(DAY, pmod({modifier[-1]} + 1 - dayofweek({moment}), 7), {moment})"
        elif modifier not in ("utc", "localtime", "auto", "subsec"):  # moments are of no zone here
            return None
    return moment


def _time(name: str, args: list[str]) -> str | None:
    """One of the functions of time in Spark's words; None where an argument is beyond them."""
    if name == "strftime":
        if not args:
            return None
        pattern, args = _literal(args[0]), args[1:]
    else:
        pattern = FORMATS.get(name, "")
    moment = _moment(args)
    if moment is None or pattern is None:
        return None
    if name == "strftime" and len(args) == 1 and args[0].lower() != "'now'" and not any(x in pattern for x in COMPUTED):
        moment = args[0]  # date_format casts
    if name == "julianday":
        return f"(unix_micros({moment}) / 86400000000D + 2440587.5D)"
    parts = [""]  # patterns of date_format, and expressions between them
    for x in re.findall("%.|[^%]+|%", pattern, re.DOTALL):
        if x in COMPUTED:
            parts += [COMPUTED[x].format(moment), ""]
        else:
            parts[-1] += DIRECTIVES.get(x) or re.sub("[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", x)
    texts = [x if i % 2 else f"date_format({moment}, {_quoted(x)})" for i, x in enumerate(parts) if x]
    return texts[0] if len(texts) == 1 else f"concat({', '.join(texts)})" if texts else "''"


def _printf(args: list[str]) -> str | None:
    """printf with each argument cast to what its directive asks for; null counts as 0 or as an empty text, and so does an argument that is not there."""
    pattern, out, rest = _literal(args[0]) if args else None, [], args[1:]
    if pattern is None:
        return None

    def directive(m: re.Match) -> str:
        if m[4] == "%":
            return "%%"
        arg, kind = rest.pop(0) if rest else "NULL", {"i": "d", "u": "d"}.get(m[4], m[4])
        if kind in "dxXo":
            out.append(f"coalesce({_prefix(arg, 'BIGINT')}, 0L)")
        elif kind in "feEgG":
            out.append(f"coalesce({_prefix(arg, 'REAL')}, 0D)")
        else:
            text = f"coalesce(cast({arg} AS string), '')"
            out.append(f"substr({text}, 1, 1)" if kind == "c" else text)
            kind = "s"
        flags = m[1] if kind != "s" else m[1].replace("0", "").replace(",", "").replace("+", "").replace(" ", "").replace("#", "")
        return f"%{flags}{m[2]}{m[3] if kind not in 'dxXo' else ''}{kind}"

    pattern = _DIRECTIVE.sub(directive, pattern)
    return f"format_string({', '.join([_quoted(pattern), *out])})"


def _number(literal: str) -> str:
    """The number that a string literal begins with, 0 without one."""
    m = re.match(r"\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", literal[1:-1])
    return "0" if not m else m[1] if m[1][0] not in "+-" else f"({m[1]})"


def _as_numbers(tokens: list[str]) -> list[str]:
    """Text in arithmetic as numbers: literals, and an operand to which 0 is added or that is taken once, as this asks for a number."""
    k = 1
    while k < len(tokens):
        x, last, after = tokens[k], k - 1, _next(tokens, k)
        while last > 0 and tokens[last].isspace():
            last -= 1
        if x in ("+", "-", "*", "/", "%") and after < len(tokens) and tokens[last][0] not in "(,+-*/%=<>|.; " and tokens[last].upper() not in _NO_OPERAND:
            begin, follows = _unit_before(tokens, k), tokens[_next(tokens, after) : _next(tokens, after) + 1]
            before = "".join(tokens[max(begin - 3, 0) : begin]).upper().split()[-1:] if begin >= 0 else []
            part = bool(before) and before[0].endswith(("|", "OVER"))  # of a text put together, or of a window's call
            for at in (last, after):
                if tokens[at][0] == "'" and not (part and at == last):
                    tokens[at] = _number(tokens[at])
            asked = tokens[after] in _ASKS_NUMBER.get(x, ()) and follows not in (["*"], ["/"], ["%"], ["|"]) and tokens[last][0] not in "'.0123456789"
            if asked and begin >= 0 and not part:
                tokens = [*tokens[:begin], "CAST", "(", *tokens[begin : last + 1], " ", "AS", " ", "REAL", ")", *tokens[last + 1 :]]
                k += 7
        k += 1
    return tokens


def _next(tokens: list[str], k: int) -> int:
    """The next token that is no white space."""
    k += 1
    while k < len(tokens) and tokens[k].isspace():
        k += 1
    return k


def _glob(pattern: str) -> str:
    """A GLOB pattern as a literal of a regular expression."""
    out = "".join({"*": ".*", "?": ".", "[": "[", "]": "]", "^": "^", "-": "-"}.get(c, re.escape(c)) for c in pattern)
    return "'" + f"(?s)^(?:{out})$".replace("\\", "\\\\") + "'"


def _cast(tokens: list[str], at: int) -> tuple[str, int] | None:
    """CAST(x AS kind), whose parenthesis opens at `at`, for numbers: text gives the number that it begins with."""
    if not (found := _arguments(tokens, at)) or len(found[0]) != 1:
        return None
    m = re.fullmatch(r"(.*\S)\s+AS\s+(\w+)", found[0][0], re.DOTALL | re.IGNORECASE)
    if not m or m[2].upper() not in _NUMBER:
        return None
    return _prefix(m[1], m[2].upper()), found[1]


def _prefix(x: str, name: str) -> str:
    """x as a number: text gives the number that it begins with."""
    kind, pattern = _NUMBER[name]
    prefix = f"coalesce(try_cast(regexp_extract(cast({x} AS string), '{pattern}', 1) AS {kind}), 0)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN typeof({x}) = 'string' THEN {prefix} ELSE cast({x} AS {kind}) END)"


def _unit_before(tokens: list[str], k: int) -> int:
    """Where the operand that ends before token k begins, white space between left in place."""
    k -= 1
    while k >= 0 and tokens[k].isspace():
        k -= 1
    if k >= 0 and tokens[k] == ")":
        depth = 0
        while k >= 0:
            depth += (tokens[k] == ")") - (tokens[k] == "(")
            if depth == 0:
                break
            k -= 1
        if k > 0 and re.fullmatch(r"[A-Za-z_]\w*", tokens[k - 1]) and tokens[k - 1].upper() not in ("AND", "OR", "NOT", "IN", "SELECT", "WHERE", "ON", "BY", "THEN", "ELSE", "WHEN", "HAVING", "CASE"):
            k -= 1
        return k
    while k >= 2 and tokens[k - 1] == ".":
        k -= 2
    return k


def _unit_after(tokens: list[str], k: int) -> int:
    """Where the operand that begins after token k ends (the token after it)."""
    k = _next(tokens, k)
    while k < len(tokens) and tokens[k] in "+-":
        k = _next(tokens, k)
    k += tokens[k : k + 1] != ["("]
    while k + 1 < len(tokens) and tokens[k] == ".":
        k += 2
    if k < len(tokens) and tokens[k] == "(":
        depth = 0
        while k < len(tokens):
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            k += 1
            if depth == 0:
                break
    return k


def _divisions(tokens: list[str]) -> list[str]:
    """Each a / b so that integers truncate. What is multiplied or divided before belongs to a."""
    k = 0
    while k < len(tokens):
        if tokens[k] == "/":
            begin = _unit_before(tokens, k)
            while True:  # the chain of factors to the left
                j = begin - 1
                while j >= 0 and tokens[j].isspace():
                    j -= 1
                if j < 1 or tokens[j] not in ("*", "%"):
                    break
                begin = _unit_before(tokens, j)
            end = _unit_after(tokens, k)
            if begin < 0 or end > len(tokens):
                return tokens
            a, b = "".join(tokens[begin:k]).strip(), "".join(_divisions(tokens[k + 1 : end])).strip()
            whole = f"typeof({a}) IN {_WHOLE} AND typeof({b}) IN {_WHOLE}"
            tokens = [*tokens[:begin], "(", f"CASE WHEN {whole} THEN cast(({a}) / ({b}) AS bigint) ELSE ({a}) / ({b}) END", ")", *tokens[end:]]
            k = begin + 2
        k += 1
    return tokens


def to_spark(sql: str, sandbox: bool = False) -> str:
    """Bracketed and double-quoted identifiers become backticked, renamed functions get Spark's name, group_concat, strftime, date, datetime and julianday become Spark's functions, GLOB and casts to numbers and `/` keep
    SQLite's meaning, trailing semicolons go. In sandbox mode LIKE ignores case."""
    tokens = _as_numbers(_TOKEN.findall(re.sub(r"[;\s]+$", "", sql)))
    if sandbox:
        tokens = ["ILIKE" if x.upper() == "LIKE" else x for x in tokens]
    return "".join(_divisions(_TOKEN.findall(_rewritten(tokens)))) if "/" in tokens else _rewritten(tokens)
