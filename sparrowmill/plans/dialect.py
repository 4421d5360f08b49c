"""The SQL dialect that the engine's sessions accept, rewritten into Spark's.

The text is cut into tokens, parentheses make a tree, and expressions are rewritten where Spark means something else:

- integer division truncates, division and modulo by zero give NULL
- SUBSTR counts a start of 0 as the place before the first character
- a backslash is an ordinary character, in strings and in LIKE patterns; "x" is an identifier; 1.5 is a double
- ORDER BY puts NULLs first in both directions
- IN drops list elements of another kind than its operand
- COUNT(DISTINCT x) OVER (..) is allowed; SUM, AVG and STDDEV_SAMP of a string are not
- a name given in the SELECT list may be used in WHERE
- numbers stand for truth values beside OR, and truth values are 0 and 1 in results

Types aren't guessed: the statement is analysed once by Spark with each expression whose type matters marked by a struct
field of its own name, and the types are read off the analysed plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<symbol><>|!=|<=|>=|\|\||::|.)""",
    re.S,
)
_WORDS = frozenset(
    "select from where group by order having limit offset union except intersect all distinct as on using join inner left right full outer cross natural and or not in is "
    "between like ilike exists when then else end asc desc nulls first last over partition rows range unbounded preceding following current row with recursive values "
    "into set insert update delete create table view drop if".split()
)
#: Words that end what stands before a comparison or IN.
_BORDERS = _WORDS - {"distinct", "row"} | {",", "=", "<>", "!=", "<", "<=", ">", ">=", "case"}
_TEXTS = ("sum", "avg", "stddev_samp")
_RANKS = ("rank", "dense_rank", "row_number")
#: Names of types in casts that Spark calls otherwise.
_TYPES = {"text": "STRING", "varchar": "STRING", "char": "STRING", "long": "BIGINT", "integer": "INT", "datetime": "TIMESTAMP"}


@dataclass
class Token:
    kind: str
    text: str

    def __str__(self) -> str:
        return self.text

    @property
    def low(self) -> str:
        return self.text.lower()


@dataclass
class Group:
    """What stands in parentheses."""

    items: list


@dataclass
class Division:
    left: object
    right: object


@dataclass
class Listed:
    """operand [NOT] IN (elements), where elements are of several kinds."""

    operand: list
    negated: bool
    elements: list


@dataclass
class Summed:
    """An aggregate's argument that must not be a string."""

    name: str
    argument: list


def tokens(text: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0]))
    return out


def statements(text: str) -> list[str]:
    """The statements of a text, without comments; semicolons in quotes don't count."""
    out, at, last = [], 0, []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "symbol" and m[0] == ";":
            out.append("".join(last))
            last = []
        else:
            last.append(" " if m[0].startswith(("--", "/*")) and not m.lastgroup else m[0])
        at = m.end()
    out.append("".join(last) + text[at:])
    return [x.strip() for x in out if x.strip()]


def _tree(flat: list[Token]) -> list:
    stack: list[list] = [[]]
    for t in flat:
        if t.kind == "symbol" and t.text == "(":
            stack.append([])
        elif t.kind == "symbol" and t.text == ")":
            if len(stack) == 1:
                raise ValueError("a parenthesis too many")
            inner = stack.pop()
            stack[-1].append(Group(inner))
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise ValueError("a parenthesis isn't closed")
    return stack[0]


def _word(x, *words: str) -> bool:
    return isinstance(x, Token) and x.kind == "name" and x.low in words


def _symbol(x, *symbols: str) -> bool:
    return isinstance(x, Token) and x.kind == "symbol" and x.text in symbols


def _split(items: list, symbol: str = ",") -> list[list]:
    out: list[list] = [[]]
    for x in items:
        if _symbol(x, symbol):
            out.append([])
        else:
            out[-1].append(x)
    return out


def _sym(text: str) -> Token:
    return Token("symbol", text)


def _name(text: str) -> Token:
    return Token("name", text)


def _kind(items: list) -> str:
    """string, number, or other, of an expression of literals."""
    flat = [y for x in items for y in ([Token("kind", _kind(x.items))] if isinstance(x, Group) else [Token("kind", "other")] if not isinstance(x, Token) else [x])]
    kinds = {("number" if t.text == "number" else "string" if t.text == "string" else "other") if t.kind == "kind" else t.kind for t in flat if not (t.kind == "symbol" and t.text in "+-*")}
    return kinds.pop() if len(kinds) == 1 and kinds <= {"string", "number"} else "other"


def _ordinals(items: list) -> list:
    """In SELECT DISTINCT, an ORDER BY item that is written like an item of the list is that item, by its number."""
    i = next((k for k, x in enumerate(items) if _word(x, "select")), None)
    if i is None or i + 1 >= len(items) or not _word(items[i + 1], "distinct"):
        return items
    ends = [k for k in range(i, len(items)) if _word(items[k], "from")]
    order = next((k for k in range(i, len(items) - 1) if _word(items[k], "order") and _word(items[k + 1], "by")), None)
    if not ends or order is None:
        return items
    listed = [_plain(x) for x in _split(items[i + 2 : ends[0]])]
    stop = next((k for k in range(order, len(items)) if _word(items[k], "limit", "offset")), len(items))
    out = []
    for item in _split(items[order + 2 : stop]):
        cut = next((k for k, x in enumerate(item) if _word(x, "asc", "desc", "nulls")), len(item))
        text = _plain(item[:cut])
        head = [Token("number", str(listed.index(text) + 1))] if text in listed and len(item[:cut]) > 1 else item[:cut]
        out += ([_sym(",")] if out else []) + head + item[cut:]
    return [*items[: order + 2], *out, *items[stop:]]


_AGGREGATES = ("min", "max", "sum", "avg", "count", "stddev_samp", "any")


def _names_from(items: list) -> set[str]:
    """The names of tables and their aliases behind FROM, up to the next clause."""
    out: set[str] = set()
    for x in items[1:]:
        if _word(x, "where", "group", "having", "order", "limit"):
            break
        if isinstance(x, Token) and x.kind in ("name", "quoted"):
            out.add(x.text.strip('"`').lower())
    return out


def _outer_terms(group: Group) -> Group:
    """(SELECT aggregate + t.a FROM u), t being outside, as ((SELECT aggregate FROM u) + t.a)."""
    items = group.items
    if not items or not _word(items[0], "select"):
        return group
    j = next((k for k, x in enumerate(items) if _word(x, "from")), None)
    if j is None or any(_word(x, "group", "having", "union", "except", "intersect") for x in items[j:]):
        return group
    own = _names_from(items[j:])
    terms = _split(items[1:j], "+")
    outer = [t for t in terms if len(t) == 3 and _symbol(t[1], ".") and isinstance(t[0], Token) and t[0].text.strip('"`').lower() not in own]
    inner = [t for t in terms if t not in outer]
    if not outer or not inner or not any(_word(t[0], *_AGGREGATES) and len(t) == 2 for t in inner if t) or any(_symbol(x, ",") for t in inner for x in t):
        return group
    kept = [y for k, t in enumerate(inner) for y in ([_sym("+")] if k else []) + t]
    return Group([Group([items[0], *kept, *items[j:]]), *(y for t in outer for y in [_sym("+"), *t])])


class _Rewriter:
    def level(self, items: list) -> list:
        """The items of one parenthesis, rewritten."""
        items = _ordinals(items)
        out: list = []
        i = 0
        while i < len(items):
            x = items[i]
            if _word(x, "desc") and not (i + 1 < len(items) and _word(items[i + 1], "nulls")):
                out += [x, _name("NULLS"), _name("FIRST")]
                i += 1
            elif _word(x, "like", "ilike") and i + 1 < len(items):
                pattern, i = self.product(items, i + 1)
                if len(pattern) == 1 and isinstance(pattern[0], Token) and pattern[0].kind == "string":
                    pattern = [Token("string", pattern[0].text.replace("\\", "\\\\"))]
                else:
                    pattern = [_name("replace"), Group([*pattern, _sym(","), Token("string", "'\\'"), _sym(","), Token("string", "'\\\\'")])]
                out += [x, *pattern]
            elif _word(x, "in") and i + 1 < len(items) and isinstance(items[i + 1], Group) and not self.is_query(items[i + 1]):
                self.in_list(out, items[i + 1])
                i += 2
            elif isinstance(x, Token) and x.kind == "number" and self.truth(out, items, i):
                out.append(Group([x, _sym("<>"), Token("number", "0")]))
                i += 1
            elif self.starts(items, i):
                product, i = self.product(items, i)
                out += product
            elif isinstance(x, Group):
                out.append(Group(self.level(x.items)))
                i += 1
            else:
                out.append(x)
                i += 1
        return out

    @staticmethod
    def truth(out: list, items: list, i: int) -> bool:
        before = out[-1] if out else None
        after = items[i + 1] if i + 1 < len(items) else None
        return _word(before, "or", "where", "having", "not") and (after is None or _word(after, "or", "and", "group", "order", "limit")) or (_word(after, "or") and (before is None or _word(before, "where", "having")))

    @staticmethod
    def is_query(group: Group) -> bool:
        return bool(group.items) and (_word(group.items[0], "select", "with", "values") or isinstance(group.items[0], Group) and _Rewriter.is_query(group.items[0]))

    def starts(self, items: list, i: int) -> bool:
        """Whether an operand starts here."""
        x = items[i]
        if isinstance(x, Group):
            return True
        return x.kind in ("string", "quoted", "number") or x.kind == "name" and (x.low not in _WORDS or x.low in ("left", "right", "if") and i + 1 < len(items) and isinstance(items[i + 1], Group)) or x.text == "?"

    def product(self, items: list, i: int) -> tuple[list, int]:
        """Operands joined by *, / and %, from place i on; signs before an operand belong to it."""
        left, i = self.operand(items, i)
        while i + 1 < len(items) and _symbol(items[i], "*", "/", "%"):
            j = i + 1
            while j < len(items) and _symbol(items[j], "-", "+"):
                j += 1
            if j >= len(items) or not self.starts(items, j):
                break
            right, after = self.operand(items, i + 1)
            sign = items[i].text
            if sign == "/":
                left = [Division(left, right)]
            elif sign == "%":
                left = [Group([*left, _sym("%"), _name("nullif"), Group([*right, _sym(","), Token("number", "0")])])]
            else:
                left = [*left, items[i], *right]
            i = after
        return left, i

    def operand(self, items: list, i: int) -> tuple[list, int]:
        out = []
        while _symbol(items[i], "-", "+"):
            out.append(items[i])
            i += 1
        x = items[i]
        if isinstance(x, Group):
            return [*out, Group(self.level(_outer_terms(x).items))], i + 1
        if _word(x, "case"):
            depth, j = 0, i
            while j < len(items):
                depth += _word(items[j], "case")
                depth -= _word(items[j], "end")
                if not depth:
                    break
                j += 1
            return [*out, x, *self.level(items[i + 1 : j]), _name("END")], j + 1
        if _word(x, "date", "timestamp", "interval") and i + 1 < len(items) and items[i + 1].__class__ is Token and items[i + 1].kind in ("string", "number"):
            n = 3 if x.low == "interval" and i + 2 < len(items) and isinstance(items[i + 2], Token) and items[i + 2].kind == "name" and items[i + 2].low not in _WORDS else 2
            return [*out, *items[i : i + n]], i + n
        i += 1
        if x.kind == "name" and i < len(items) and isinstance(items[i], Group):
            over = i + 1 < len(items) and _word(items[i + 1], "over")
            out += self.call(x, items[i], over)
            i += 1
            if over:
                window = items[i + 1]
                inner = Group(self.level(window.items)) if isinstance(window, Group) else window
                if len(out) and isinstance(out[-1], tuple):  # a distinct count: sets of values over the window
                    argument = out.pop()[0]
                    out += [_name("CAST"), Group([_name("size"), Group([_name("collect_set"), Group(argument), _name("OVER"), inner]), _name("AS"), _name("BIGINT")])]
                else:
                    out += [_name("OVER"), inner]
                if x.low in _RANKS:  # of type long
                    out = [_name("CAST"), Group([*out, _name("AS"), _name("BIGINT")])]
                i += 2
            return out, i
        out.append(x)
        while i + 1 < len(items) and _symbol(items[i], "."):
            out += items[i : i + 2]
            i += 2
        return out, i

    def call(self, name: Token, arguments: Group, over: bool) -> list:
        if name.low == "cast":
            at = max((k for k, x in enumerate(arguments.items) if _word(x, "as")), default=len(arguments.items))
            kind = arguments.items[at + 1 :]
            if kind and _word(kind[0], *_TYPES):
                kind = [_name(_TYPES[kind[0].low])]
            return [name, Group([*self.level(arguments.items[:at]), _name("AS"), *kind])]
        parts = [self.level(p) for p in _split(arguments.items)]
        if name.low in ("substr", "substring") and len(parts) == 3:
            text, start, length = parts
            if len(start) == 1 and isinstance(start[0], Token) and start[0].kind == "number" and start[0].text != "0":
                return [_name("substr"), Group([*text, _sym(","), *start, _sym(","), _name("greatest"), Group([*length, _sym(","), Token("number", "0")])])]
            zero = Group([*start, _sym("="), Token("number", "0")])
            first = [_name("if"), Group([zero, _sym(","), Token("number", "1"), _sym(","), *start])]
            size = [_name("greatest"), Group([_name("if"), Group([zero, _sym(","), Group([*length, _sym("-"), Token("number", "1")]), _sym(","), *length]), _sym(","), Token("number", "0")])]
            return [_name("substr"), Group([*text, _sym(","), *first, _sym(","), *size])]
        if name.low == "count" and over and arguments.items and _word(arguments.items[0], "distinct"):
            return [(self.level(arguments.items[1:]),)]
        if name.low in _TEXTS and len(parts) == 1:
            distinct = parts[0][:1] if parts[0] and _word(parts[0][0], "distinct") else []
            return [name, Group([*distinct, Summed(name.low, parts[0][len(distinct) :])])]
        return [name, Group([y for k, p in enumerate(parts) for y in ([_sym(",")] if k else []) + p])]

    def in_list(self, out: list, group: Group) -> None:
        elements = [self.level(p) for p in _split(group.items)]
        kinds = {_kind(e) for e in elements}
        if not {"string", "number"} <= kinds:
            out += [_name("IN"), Group([y for k, e in enumerate(elements) for y in ([_sym(",")] if k else []) + e])]
            return
        negated = _word(out[-1], "not") if out else False
        if negated:
            out.pop()
        operand: list = []
        while out and not (isinstance(out[-1], Token) and out[-1].kind in ("name", "symbol") and out[-1].low in _BORDERS):
            operand.insert(0, out.pop())
        out.append(Listed(operand, negated, elements))


class _Text:
    """Writes a rewritten tree as Spark SQL. Without types, what needs one is marked; with types, it is resolved."""

    def __init__(self, types: dict[str, str] | None = None):
        self.types, self.marks = types, 0

    def of(self, x) -> str:
        if isinstance(x, list):
            return " ".join(self.of(y) for y in x)
        if isinstance(x, Token):
            return self.token(x)
        if isinstance(x, Group):
            return f"({self.of(x.items)})"
        if isinstance(x, Division):
            return self.division(x)
        if isinstance(x, Listed):
            return self.listed(x)
        return self.summed(x)

    @staticmethod
    def token(x: Token) -> str:
        if x.kind == "string":
            return x.text.replace("\\", "\\\\").replace("''", "\\'") if "''" in x.text[1:-1] else x.text.replace("\\", "\\\\")
        if x.kind == "quoted" and x.text[0] == '"':
            return "`" + x.text[1:-1].replace('""', '"').replace("`", "``") + "`"
        if x.kind == "number" and ("." in x.text or "e" in x.low):
            return x.text + "D"
        return x.text

    def marked(self, text: str, key: str) -> tuple[str, str | None]:
        """The text, marked if types are still to be found, and its type if that is known. Equal texts share a mark."""
        name = f"type_of_{abs(hash((key, text))):x}"
        self.marks += 1
        if self.types is None:
            return f"named_struct('{name}', {text}).{name}", None
        return text, self.types.get(name)

    def division(self, x: Division) -> str:
        probe = _Text()
        left, right = probe.of(x.left), probe.of(x.right)
        # the common type of the operands is that of their product
        marked, _ = self.marked(f"(({left}) * ({right}))", "division")
        if self.types is None:
            return marked
        _, kind = self.marked(f"(({left}) * ({right}))", "division")
        a, b = self.of(x.left), self.of(x.right)
        if kind in ("int", "bigint", "smallint", "tinyint"):
            return f"CAST(({a}) div nullif({b}, 0) AS {kind})"
        return f"(({a}) / nullif({b}, 0))" if kind != "float" else f"CAST(({a}) / nullif({b}, 0) AS float)"

    def listed(self, x: Listed) -> str:
        probe = _Text().of(x.operand)
        marked, kind = self.marked(f"({probe})", "operand")
        word = "NOT IN" if x.negated else "IN"
        if self.types is None:
            return f"(({marked}) IS NULL)"
        dropped = "number" if kind == "string" else "string"
        kept = [e for e in x.elements if _kind(e) != dropped]
        operand = self.of(x.operand)
        if not kept:
            return f"({operand} IS NULL AND NULL)" if not x.negated else f"({operand} IS NOT NULL OR NULL)"
        return f"({operand} {word} ({', '.join(self.of(e) for e in kept)}))"

    def summed(self, x: Summed) -> str:
        marked, kind = self.marked(f"({_Text().of(x.argument)})", "argument")
        if self.types is None:
            return marked
        if kind == "string":
            raise TypeError(f"{x.name} of a string")
        return self.of(x.argument)


def _types(plan) -> dict[str, str]:
    """The types of marked expressions of an analysed plan and its subqueries."""
    out: dict[str, str] = {}

    def each(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expression(e) -> None:
        if e.nodeName() == "GetStructField":
            name = e.child().dataType().fieldNames()[e.ordinal()] if e.child().dataType().typeName() == "struct" else ""
            if name.startswith("type_of_"):
                out[name] = e.dataType().simpleString()
        for c in each(e.children()):
            expression(c)

    def node(p) -> None:
        for e in each(p.expressions()):
            expression(e)
        for q in (p.subqueries(), p.children()):
            for c in each(q):
                node(c)

    node(plan)
    return out


def _names(tree: list) -> list[str] | None:
    """The names of the outermost SELECT list's columns: an item without a name of its own is named by its text. None if the
    list has a star or isn't found."""
    i = next((k for k, x in enumerate(tree) if _word(x, "select")), None)
    if i is None:
        return None
    j = next((k for k in range(i, len(tree)) if _word(tree[k], "from", "union", "except", "intersect", "order", "limit", "where")), len(tree))
    start = i + 1 + (i + 1 < len(tree) and _word(tree[i + 1], "distinct", "all"))
    out = []
    for item in _split(tree[start:j]):
        if not item or _symbol(item[-1], "*"):
            return None
        last, before = item[-1], item[-2] if len(item) > 1 else None
        plain = isinstance(last, Token) and last.kind in ("name", "quoted") and last.low not in _WORDS
        joined = isinstance(before, Token) and (before.kind == "symbol" or before.low in _WORDS - {"end", "as"})
        if plain and not joined or plain and _symbol(before, "."):
            out.append(last.text.strip('"`'))
        else:
            out.append(_plain(item))
    return out


def _plain(items: list) -> str:
    out = ""
    for x in items:
        text = f"({_plain(x.items)})" if isinstance(x, Group) else x.text
        tight = not out or out.endswith((".", "(")) or text in (".", ",") or isinstance(x, Group) and re.search(r"\w$", out) and out.split()[-1].lower() not in _WORDS
        out += text if tight else " " + text
    return out


def _only_table(items: list) -> Token | None:
    """The name of the single table that `FROM ..` starts with."""
    if len(items) < 2 or not isinstance(items[1], Token) or items[1].kind not in ("name", "quoted"):
        return None
    rest = items[2:]
    name = items[1]
    if rest and _word(rest[0], "as"):
        rest = rest[1:]
    if rest and isinstance(rest[0], Token) and rest[0].kind in ("name", "quoted") and rest[0].low not in _WORDS:
        name, rest = rest[0], rest[1:]
    return name if not rest or _word(rest[0], "where", "group", "order", "limit") else None


def _aliases(tree: list) -> dict[str, list]:
    """Names given in the SELECT lists of a tree, with their expressions."""
    out: dict[str, list] = {}

    def level(items: list) -> None:
        for x in items:
            if isinstance(x, Group):
                level(x.items)
        i = next((k for k, x in enumerate(items) if _word(x, "select")), None)
        if i is None:
            return
        j = next((k for k in range(i, len(items)) if _word(items[k], "from")), len(items))
        for item in _split(items[i + 1 : j]):
            if len(item) > 2 and _word(item[-2], "as") and isinstance(item[-1], Token):
                value = item[:-2]
                if len(value) == 1 and isinstance(value[0], Token) and value[0].kind == "name" and (table := _only_table(items[j:])):
                    value = [table, _sym("."), value[0]]  # in a subquery the bare name might mean another column
                out[item[-1].text.strip('"`').lower()] = value

    level(tree)
    return out


def _with_alias(items: list, name: str, value: list) -> list:
    """In WHERE clauses the name stands for the value."""
    out, inside = [], False

    def put(items: list) -> list:
        got = []
        for k, x in enumerate(items):
            if isinstance(x, Group):
                got.append(Group(put(x.items)))
            elif isinstance(x, Token) and x.kind in ("name", "quoted") and x.text.strip('"`').lower() == name and not (k and _symbol(items[k - 1], ".")) and not (k + 1 < len(items) and _symbol(items[k + 1], ".")):
                got.append(Group(value))
            else:
                got.append(x)
        return got

    for x in items:
        if _word(x, "where"):
            inside = True
        elif _word(x, "group", "having", "order", "limit", "union", "except", "intersect", "select"):
            inside = False
        if inside and not _word(x, "where"):
            out += put([x]) if not (out and _symbol(out[-1], ".")) else [x]
        else:
            out.append(Group(_with_alias(x.items, name, value)) if isinstance(x, Group) else x)
    return out


def _resolved(tree: list, error: AnalysisException, tried: set[str]) -> list:
    """The tree with a name that Spark doesn't know replaced by what the SELECT list gives that name to; else raises."""
    m = re.search(r"with name `([^`]+)`", str(error))
    name = m[1].lower() if m and "UNRESOLVED_COLUMN" in str(error) else None
    value = _aliases(tree).get(name) if name and name not in tried else None
    if value is None:
        raise error
    tried.add(name)
    return _with_alias(tree, name, value)


def _check_branches(spark: SparkSession, tree: list, types: dict[str, str], args) -> None:
    """The branches of a set operation have columns of equal types (NULL is of any)."""
    if not tree or not _word(tree[0], "select") or not any(_word(x, "union", "except", "intersect") for x in tree):
        return
    branches: list[list] = [[]]
    for x in tree:
        if _word(x, "union", "except", "intersect"):
            branches.append([])
        elif not (_word(x, "all", "distinct") and not branches[-1]):
            branches[-1].append(x)
    end = next((k for k, x in enumerate(branches[-1]) if _word(x, "order", "limit")), None)
    branches[-1] = branches[-1][:end]
    texts = [_Text(types).of(b) for b in branches]
    schemas = [(spark.sql(t, args=args) if args else spark.sql(t)).schema for t in texts]
    for other in schemas[1:]:
        for f, g in zip(schemas[0].fields, other.fields):
            if f.dataType != g.dataType and not isinstance(f.dataType, T.NullType) and not isinstance(g.dataType, T.NullType):
                raise TypeError(f"a set operation over {f.dataType.simpleString()} and {g.dataType.simpleString()}")


def query(spark: SparkSession, text: str, args: list | None = None) -> DataFrame:
    """The result of a SELECT in the dialect, over the temporary views of the session. args: values of its placeholders."""
    flat = tokens(text)
    if args:
        # by names, as rewriting may write an operand twice
        places = [t for t in flat if t.text == "?"]
        for i, t in enumerate(places):
            t.kind, t.text = "quoted", f":p{i}"
        args = {f"p{i}": value for i, value in enumerate(args)}
    tree = _tree(flat)
    tried: set[str] = set()
    while True:
        new = _Rewriter().level(tree)
        try:
            probe = _Text()
            marked = probe.of(new)
            final, final_types = marked, {}
            if probe.marks:
                plan = (spark.sql(marked, args=args) if args else spark.sql(marked))._jdf.queryExecution().analyzed()
                final_types = _types(plan)
                final = _Text(final_types).of(new)
            out = spark.sql(final, args=args) if args else spark.sql(final)
            break
        except AnalysisException as error:
            tree = _resolved(tree, error, tried)
    _check_branches(spark, new, final_types, args)
    names = _names(tree) or out.columns
    names = names if len(names) == len(out.columns) else out.columns
    out = out.toDF(*(f"c{i}" for i in range(len(names))))
    cells = [F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name) for f in out.schema.fields]
    return out.select(*(c.alias(n) for c, n in zip(cells, names)))
