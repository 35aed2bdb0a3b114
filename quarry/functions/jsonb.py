"""JSON documents as variants: extraction, containment, keys, paths and changes.

A JSON null is a value, and differs from SQL's null. Numbers are compared by value, so 1
and 1.0 are equal. Constant right-hand sides and paths are taken apart on the driver and
become column expressions, and so do changes to documents: what stands along a constant
path is rebuilt, and everything else is kept as it is. What a change needs more than once
is named by a lambda, so that it is worked out once a row, and expressions that take
other changes grow by their number.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.parse_json(text)


def _step(key: str | int) -> str:
    return f"[{key}]" if isinstance(key, int) else "['" + key.replace("'", "\\'") + "']"


def path_of(text: str) -> list[str | int]:
    """The keys of '{a,b,0}'."""
    return [int(p) if p.isdigit() else p for p in (x.strip().strip('"') for x in text.strip("{}").split(",")) if p]


def get(v: Column, *keys: str | int) -> Column:
    """The value at keys (-> and #>), null where there is none."""
    return F.try_variant_get(v, "$" + "".join(map(_step, keys)), "variant")


def get_text(v: Column, *keys: str | int) -> Column:
    """As text (->> and #>>): strings without quotes, a JSON null as null."""
    found = get(v, *keys)
    kind = type_of(found)
    return F.when(kind == "string", F.try_variant_get(found, "$", "string")).when(kind != "null", F.to_json(found))


def type_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(F.is_variant_null(v), "null")
        .when(kind.isNotNull(), "number")
    )


def elements(v: Column) -> Column:
    """An array's elements; none for anything else."""
    return F.coalesce(F.when(type_of(v) == "array", F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def array_length(v: Column) -> Column:
    return F.when(type_of(v) == "array", F.size(elements(v))).otherwise(F.raise_error(F.lit("not an array")).cast("int"))


def object_keys(v: Column) -> Column:
    """An object's keys in order."""
    return F.array_sort(F.when(type_of(v) == "object", F.json_object_keys(F.to_json(v))))


def contains(v: Column, wanted) -> Column:
    """v @> wanted: all of an object's members, and for each element of an array some
    element that contains it. wanted: a Python value, or JSON text of an object or array."""
    if isinstance(wanted, str) and wanted[:1] in "{[":
        wanted = json.loads(wanted)
    return F.coalesce(_contains(v, wanted), F.lit(False))


def _contains(v: Column, wanted) -> Column:
    if isinstance(wanted, dict):
        out = type_of(v) == "object"
        for key, value in wanted.items():
            out = out & F.coalesce(_contains(get(v, key), value), F.lit(False))
        return out
    if isinstance(wanted, list):
        out = type_of(v) == "array"
        for value in wanted:
            out = out & _some_contains(v, value)
        return out
    if wanted is None:
        return F.is_variant_null(v)
    if isinstance(wanted, bool):
        return (type_of(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (type_of(v) == "string") & (F.try_variant_get(v, "$", "string") == wanted)
    return (type_of(v) == "number") & (F.try_variant_get(v, "$", "double") == float(wanted))


def _some_contains(v: Column, wanted) -> Column:
    return F.exists(elements(v), lambda e: F.coalesce(_contains(e, wanted), F.lit(False)))


def has_key(v: Column, key: str) -> Column:
    """An object has the key, or an array the string."""
    inside = F.exists(elements(v), lambda e: F.coalesce((type_of(e) == "string") & (F.try_variant_get(e, "$", "string") == key), F.lit(False)))
    return F.when(type_of(v) == "object", F.array_contains(F.json_object_keys(F.to_json(v)), key)).otherwise(inside)


def has_any(v: Column, keys: list[str]) -> Column:
    out = has_key(v, keys[0])
    for k in keys[1:]:
        out = out | has_key(v, k)
    return out


def has_all(v: Column, keys: list[str]) -> Column:
    out = has_key(v, keys[0])
    for k in keys[1:]:
        out = out & has_key(v, k)
    return out


_PATH = re.compile(r"\.\.(\w+|\*)|\.(\w+)\(\s*\)|\.(\w+)|\[\s*(-?\d+)\s*\]|\[\s*(-?\d+)\s+to\s+(-?\d+)\s*\]|(?:\[\s*(\*)\s*\]|\.\*)|\[(?:'([^']*)'|\"([^\"]*)\")\]|\s*\?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
_TEST = re.compile(r"^\s*@((?:\.\w+|\[\d+\]|\['[^']*'\])*)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*$")


def path_values(v: Column, path: str) -> Column:
    """The values at a path, as an array: members, ['k'], [n] (from the end if negative),
    [n to m], [*] and .* (an array's elements or an object's values), ..k and ..* (at any
    depth), type(), size() and length(), and ? (tests joined by && or ||, on @ and what is
    below it)."""
    text = re.sub(r"^\s*(?:strict|lax)?\s*\$", "", path)
    out, at = F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<variant>")), 0
    while at < len(text.rstrip()):
        m = _PATH.match(text, at)
        if not m:
            raise ValueError(f"this path isn't supported: {path!r}")
        at = m.end()
        deep, method, member, index, low, high, _, single, double, test = m.groups()
        if test is not None:
            out = _passing(out, test)
        elif deep:
            out = _descendants(v, out) if deep == "*" else _below(F.concat(out, _descendants(v, out)), deep)
        elif method:
            out = _method(out, method)
        elif index:
            out = _at(out, int(index), int(index))
        elif low:
            out = _at(out, int(low), int(high))
        elif member or single is not None or double is not None:
            out = _below(out, next(k for k in (member, single, double) if k is not None))
        else:
            out = F.flatten(F.transform(out, _children))
    return out


def _children(e: Column) -> Column:
    return F.concat(elements(e), F.coalesce(F.map_values(_members(e)), F.array().cast("array<variant>")))


def _members(v: Column) -> Column:
    """An object's members as a map, null for anything else."""
    return F.when(type_of(v) == "object", F.try_variant_get(v, "$", "map<string,variant>"))


def _descendants(v: Column, values: Column) -> Column:
    """All that stands below values in v, level by level. No value is deeper than v has
    opening brackets."""
    text = F.coalesce(F.to_json(v), F.lit(""))
    levels = F.sequence(F.lit(0), F.length(text) - F.length(F.translate(text, "[{", "")))
    none = F.array().cast("array<variant>")
    start = F.struct(F.coalesce(values, none).alias("level"), none.alias("found"))

    def down(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["level"], _children))
        return F.struct(below.alias("level"), F.concat(state["found"], below).alias("found"))

    return F.aggregate(levels, start, down)["found"]


def _at(values: Column, low: int, high: int) -> Column:
    """Elements from low to high, which count from the end where they are negative."""

    def own(e: Column) -> Column:
        n = F.size(elements(e))
        first = F.lit(low) if low >= 0 else F.greatest(n + low, F.lit(0) if low != high else n + low)
        last = F.lit(high) if high >= 0 else n + high
        return F.when((first >= 0) & (last >= first), F.slice(elements(e), first + 1, last - first + 1)).otherwise(F.array().cast("array<variant>"))

    return F.flatten(F.transform(values, own))


def _method(values: Column, name: str) -> Column:
    if name == "type":
        return F.transform(values, lambda e: F.parse_json(F.concat(F.lit('"'), type_of(e), F.lit('"'))))
    if name == "size":
        n = lambda e: F.when(type_of(e) == "array", F.size(elements(e)))
    elif name == "length":
        n = lambda e: F.when(type_of(e) == "array", F.size(elements(e))).when(type_of(e) == "object", F.size(_members(e))).when(type_of(e) == "string", F.length(F.try_variant_get(e, "$", "string")))
    else:
        raise ValueError(f"this method isn't supported: {name!r}")
    return F.filter(F.transform(values, lambda e: F.parse_json(n(e).cast("string"))), lambda x: x.isNotNull())


def _passing(values: Column, test: str) -> Column:
    return F.filter(values, lambda e: F.coalesce(_test(e, test), F.lit(False)))


def _below(values: Column, key: str | int) -> Column:
    return F.filter(F.transform(values, lambda e: get(e, key)), lambda e: e.isNotNull())


def _test(e: Column, text: str) -> Column:
    for mark, join in (("||", lambda a, b: a | b), ("&&", lambda a, b: a & b)):
        if mark in text:
            left, right = text.split(mark, 1)
            return join(F.coalesce(_test(e, left), F.lit(False)), F.coalesce(_test(e, right), F.lit(False)))
    text = text.strip()
    if text.startswith("exists"):
        inner = text[text.index("(") + 1 : text.rindex(")")].strip().removeprefix("@")
        return F.size(path_values(e, "$" + inner)) > 0
    m = _TEST.match(text)
    if not m:
        raise ValueError(f"this test isn't supported: {text!r}")
    keys = [int(n) if n else a or q for a, n, q in re.findall(r"\.(\w+)|\[(\d+)\]|\['([^']*)'\]", m[1])]
    value = get(e, *keys) if keys else e
    wanted = json.loads(m[3].replace("'", '"'))
    if m[2] in ("==", "!="):
        same = F.coalesce(_contains(value, wanted), F.lit(False))
        return same if m[2] == "==" else value.isNotNull() & ~same
    kind, name = ("number", "double") if isinstance(wanted, (int, float)) else ("string", "string")
    own = F.when(type_of(value) == kind, F.try_variant_get(value, "$", name))
    return {"<": own < wanted, "<=": own <= wanted, ">": own > wanted, ">=": own >= wanted}[m[2]]


def path_exists(v: Column, path: str) -> Column:
    return F.size(path_values(v, path)) > 0


# --- changes: JSON text in, JSON text out, keys in order ---------------------------------


def _value(x) -> Column:
    return F.parse_json(F.lit(json.dumps(x)))


def _let(x: Column, use) -> Column:
    """use(x), with x worked out once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _as_map(v: Column) -> Column:
    """An object's members, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_array(v: Column) -> Column:
    """An array's elements, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _packed(nested: Column) -> Column:
    return F.to_variant_object(nested)


def _index(key: str | int, size: Column) -> Column | None:
    """A key's place in an array, from the end if negative; None if it isn't a number."""
    try:
        i = int(key)
    except ValueError:
        return None
    return F.lit(i) if i >= 0 else size + i


def _rebuilt(v: Column, path: list[str | int], in_object, in_array) -> Column:
    """v with a change at a path. in_object(members, key) and in_array(elements, place) give
    the parent's new members or elements; values on the way that lack the key stay."""
    key, rest = str(path[0]), path[1:]
    again = lambda x: _rebuilt(x, rest, in_object, in_array)

    def inside(members: Column) -> Column:
        return F.transform_values(members, lambda k, x: F.when(k == key, again(x)).otherwise(x)) if rest else in_object(members, key)

    def among(own: Column) -> Column:
        place = _index(path[0], F.size(own))
        return F.transform(own, lambda x, i: F.when(i == place, again(x)).otherwise(x)) if rest else in_array(own, place)

    def change(x: Column) -> Column:
        out = [_packed(_let(_as_map(x), inside))]
        if _index(path[0], F.lit(0)) is not None:
            out.append(_packed(_let(_as_array(x), among)))
        return F.coalesce(*out, x)

    return _let(v, change)


def _text(v: Column) -> Column:
    return F.to_json(v)


def _without(members: Column, key: str) -> Column:
    return F.map_filter(members, lambda k, _: k != key)


def _with(members: Column, key: str, value: Column) -> Column:
    return F.map_concat(_without(members, key), F.create_map(F.lit(key), value))


def delete_path(doc: Column, path: list[str | int]) -> Column:
    if not path:
        return _text(parse(doc))
    return _text(_rebuilt(parse(doc), path, _without, lambda own, place: F.filter(own, lambda _, i: i != place)))


def set_path(doc: Column, path: list[str | int], value, create: bool = True) -> Column:
    """Without create only what is there changes; an index past an array's ends adds there."""
    if not path:
        return _text(parse(doc))
    new = _value(value)

    def put(members: Column, key: str) -> Column:
        return _with(members, key, new) if create else F.when(F.map_contains_key(members, key), _with(members, key, new)).otherwise(members)

    def put_at(own: Column, place: Column) -> Column:
        out = F.transform(own, lambda x, i: F.when(i == place, new).otherwise(x))
        return F.when(place < 0, F.concat(F.array(new), own)).when(place >= F.size(own), F.concat(own, F.array(new))).otherwise(out) if create else out

    return _text(_rebuilt(parse(doc), path, put, put_at))


def insert_path(doc: Column, path: list[str | int], value, after: bool = False) -> Column:
    """A member that is there stays; an array's elements make room."""
    if not path:
        return _text(parse(doc))
    new = _value(value)

    def put(members: Column, key: str) -> Column:
        return F.when(F.map_contains_key(members, key), members).otherwise(_with(members, key, new))

    def put_at(own: Column, place: Column) -> Column:
        n = F.least(F.greatest(place + int(after), F.lit(0)), F.size(own))
        return F.concat(F.slice(own, F.lit(1), n), F.array(new), F.slice(own, n + 1, F.size(own) - n))

    return _text(_rebuilt(parse(doc), path, put, put_at))


def merge(left: Column, right: Column) -> Column:
    """left || right: members of both objects, the right ones win; else arrays end to end."""
    listed = lambda v: F.coalesce(_as_array(v), F.array(v))

    def both(m: Column, n: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(n, k)), n)

    def joined(a: Column, b: Column) -> Column:
        objects = _let(_as_map(a), lambda m: _let(_as_map(b), lambda n: both(m, n)))
        return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(_packed(objects), _packed(F.concat(listed(a), listed(b)))))

    return _text(_let(parse(left), lambda a: _let(parse(right), lambda b: joined(a, b))))
