"""Facts of Kotlin and TypeScript files with syntax that needs a parser, and of broken files."""

import random

import pytest

from arbora.sources.languages.kotlin import Kotlin
from arbora.sources.languages.tokens import Tokens
from arbora.sources.languages.typescript import TypeScript

KT = """@file:JvmName("X")
package a.b
import x.y.Foo as Bar
import x.z.*

/* outer /* inner */ class Not */
@Anno(x = [1, 2])
data class User<T : Any>(
    @field:Id val name: Map<
        String,
        List<Item>
    >,
    private var age: Int = compute(3),
    plain: (Int) -> Deep<Inner>?
) : Base<T>(age), Named by delegate(x) where T : Other {
    companion object { fun make(): User = User(build()) }
    val label: String
        get() = "n ${render(name)} $age"
    override fun <R> List<R>.swap(a: Int, b: R): Result<R, Error> where R : Cmp {
        val t = this[a]; count += 1; i++
        run { it.go<Foo>(1) { x: Zed -> x.walk() } }
        if (a < b && c > (d)) return call(named = 2)
        return object : Listener { override fun on(e: Event) { fire(e) } }
    }
    enum class Kind { A, B; fun odd() = helper() }
    fun `with space`() = when (x) { is Circle -> area(x); else -> 0 }
    private class Nested { fun deep() {} }
}
fun String?.ext(): Int = this?.length ?: fallback()
fun Map<String, List<Int>>.pick(f: (A) -> B): (C) -> D = { g(it) }
typealias Names = List<String>
val top = compute(1)
interface Empty
sealed interface Shape
class Z
    : Base(1),
      Other
"""
TS = """import def, { a as b, type C } from "./x";
import * as ns from '../ns';
import type { T1 } from "./t";
export { q as r, s } from "./q";
export * from "./all";
const re = /[/{"]+\\/(/g, two = 2;
@Decor({ a: make() })
export default abstract class Foo<T extends Bound = Dflt> extends ns.Base<
  T, Map<string, Item>
> implements I1, I2<X> {
  private readonly x: Map<
    string,
    Promise<Deep[]>
  > = new Map<string, Deep>();
  static #count = 0;
  ["computed" + key()](a: number): void { this.x.get(a); }
  over(a: string): A1;
  over(a: any): any { return `t ${render(a)} ${`in ${deep(1)}`}`; }
  constructor(private opts: Opts, @Inject() svc?: Svc) { super(opts); Foo.#count++; }
  get size(): number { return this.n < limit && (y) > z ? f(1) : g<Gen>(2); }
  fn = async (e: Ev): Promise<void> => { const u: Loc = await e.load(); };
  [key: string]: unknown;
}
export interface Opts { url: string; load(id: number): Promise<Item> }
type Alias<K> = K extends string ? { [P in keyof K]: Wrapped<K[P]> } : readonly Other[] | "lit";
export function over2(a: string): void;
export function over2(a: any) { const o = { run() { return inner(); }, k: v, async go(z: Zed) { } }; counter += 1; return a as Cast; }
export const make = <Q,>(o: Opts): Foo<Q> => new Foo(o);
export const { d1, d2 } = unpack();
let fnE = function named(p: P1) { return import("./lazy"); }
enum Color { Red = calc(), Blue }
const late = 1
export { late };
if (x) { for (const i of list) { call(i) } }
"""


def found(rows, kind, *columns):
    place = {"owner": 3, "id": 4, "name": 5, "detail": 6, "source": 7, "line": 8, "end": 9, "exported": 10, "signature": 11}
    return [tuple(str(r[place[c]]).rpartition("#")[2] if c in ("owner", "id") else r[place[c]] for c in columns) for r in rows if r[2] == kind]


def test_kotlin_facts():
    rows = Kotlin("a/U.kt", KT).rows
    assert found(rows, "package", "name") == [("a.b",)] and found(rows, "binding", "name", "detail", "source") == [("Bar", "Foo", "x.y.Foo")]
    assert found(rows, "symbol", "id", "detail", "line", "end") == [
        ("User", "class", 7, 28), ("User.name", "field", 8, 15), ("User.age", "field", 8, 15), ("User.label", "field", 17, 18), ("User.swap", "method", 19, 24), ("User.Kind", "class", 25, 25), ("User.with space", "method", 26, 26),
        ("User.Nested", "class", 27, 27), ("User.Nested.deep", "method", 27, 27), ("ext", "function", 29, 29), ("pick", "function", 30, 30), ("Empty", "interface", 33, 33), ("Shape", "interface", 34, 34), ("Z", "class", 35, 37)]
    assert found(rows, "base", "owner", "name") == [("User", "Base"), ("User", "Named"), ("Z", "Base"), ("Z", "Other")]
    types = set(found(rows, "annotation", "owner", "name"))
    assert {("User.name", "Map"), ("User.name", "Item"), ("User", "Inner"), ("User.swap", "List"), ("User.swap", "Error"), ("User.swap", "Foo"), ("User.swap", "Zed"), ("User.swap", "Event"), ("ext", "String"), ("pick", "Map"), ("pick", "D"), ("User.with space", "Circle")} <= types
    assert not {n for _, n in types} & {"walk", "area", "Not", "named"}
    refs = set(found(rows, "reference", "owner", "name", "detail"))
    assert refs >= {("User", "compute", "call"), ("User", "delegate", "call"), ("User", "User", "call"), ("User", "build", "call"), ("User.label", "render", "call"), ("User.label", "age", "read"), ("User.swap", "count", "write"), ("User.swap", "i", "write"),
                    ("User.swap", "go", "call"), ("User.swap", "walk", "call"), ("User.swap", "call", "call"), ("User.swap", "fire", "call"), ("User.Kind", "helper", "call"), ("User.with space", "area", "call"), ("ext", "fallback", "call"), ("pick", "g", "call")}
    assert not {n for _, n, _ in refs} & {"Not", "named", "top"} and {r for r in refs if r[1] == "b"} == {("User.swap", "b", "read")}


def test_typescript_facts():
    rows = TypeScript("a/U.ts", TS).rows
    assert found(rows, "import", "name") == [("./x",), ("../ns",), ("./t",), ("./q",), ("./all",)] and found(rows, "dynamic_import", "name") == [("./lazy",)]
    assert found(rows, "binding", "name", "detail") == [("def", "default"), ("b", "a"), ("C", "C"), ("ns", "*"), ("T1", "T1")] and found(rows, "reexport", "name", "detail") == [("r", "q"), ("s", "s"), ("*", None)]
    assert found(rows, "symbol", "id", "detail", "line", "end", "exported") == [
        ("re", "constant", 6, 6, False), ("two", "constant", 6, 6, False), ("Foo", "class", 8, 23, True), ("Foo.x", "field", 11, 14, False), ("count", "field", 15, 15, False), ('Foo.["computed" + key()]', "method", 16, 16, False), ("Foo.over", "method", 18, 18, False),
        ("Foo.constructor", "method", 19, 19, False), ("Foo.size", "method", 20, 20, False), ("Foo.fn", "field", 21, 21, False), ("Opts", "interface", 24, 24, True), ("Alias", "type_alias", 25, 25, False), ("over2", "function", 27, 27, True),
        ("make", "function", 28, 28, True), ("fnE", "function", 30, 30, False), ("Color", "enum", 31, 31, False), ("late", "constant", 32, 32, True)]
    assert found(rows, "base", "name", "detail") == [("Base", "INHERITS"), ("I1", "IMPLEMENTS"), ("I2", "IMPLEMENTS")] and found(rows, "default", "id") == [("Foo",)]
    types = set(found(rows, "annotation", "owner", "name"))
    assert {("Foo", "Bound"), ("Foo", "Item"), ("Foo", "X"), ("Foo.x", "Deep"), ("Foo.constructor", "Opts"), ("Foo.constructor", "Svc"), ("Foo.size", "Gen"), ("Foo.fn", "Loc"), ("over2", "Cast"), ("over2", "Zed"), ("make", "Opts"), ("make", "Foo"), ("fnE", "P1")} <= types
    refs = set(found(rows, "reference", "owner", "name", "detail"))
    assert refs >= {("Foo", "key", "call"), ("Foo.over", "render", "call"), ("Foo.over", "deep", "call"), ("Foo.constructor", "count", "write"), ("Foo.size", "limit", "read"), ("Foo.size", "f", "call"), ("Foo.size", "g", "call"), ("Foo.fn", "load", "call"),
                    ("over2", "inner", "call"), ("over2", "v", "read"), ("over2", "counter", "write"), ("make", "Foo", "new"), ("Color", "calc", "call")}
    assert not {(o, n) for o, n, _ in refs} & {("over2", "run"), ("over2", "k"), ("over2", "a"), ("Foo.over", "a"), ("make", "o"), ("Color", "Red")}  # names of their own


def test_barrels():
    def is_barrel(text):
        return any(r[2] == "barrel" for r in TypeScript("i.ts", text).rows)
    assert is_barrel("export * from './a';\nimport './b';\nexport { c } from './c';") and not is_barrel("export * from './a'; const x = 1;") and not is_barrel("import './b';") and not is_barrel("")


@pytest.mark.parametrize("parser, text", [(Kotlin, KT), (TypeScript, TS)])
def test_broken_files(parser, text):
    """Any piece of a file is read to its end, and what stands before a cut is found as in the whole."""
    whole = parser("p", text).rows
    for cut in range(0, len(text), 7):
        for part in (text[:cut], text[cut:]):
            parser("p", part)
    rng = random.Random(1)
    for _ in range(300):
        at, n = rng.randrange(len(text)), rng.randint(1, 9)
        parser("p", text[:at] + rng.choice(["", "{", "}", "(", ")", "<", ">", '"', "`", "/*", "${", "@", ":", "fun ", "class "]) + text[at + n:])
    first = [r for r in parser("p", text + "\nclass Later { fun (").rows if r[2] == "symbol"]
    assert [r[5] for r in first][: len([r for r in whole if r[2] == "symbol"])] == [r[5] for r in whole if r[2] == "symbol"]
    for odd in ("", "{", "}", '"open', "/* open", "(((", "class", "fun", "import", "export", "val", "class A :", "@", "x <", "`", "'", "\\"):
        parser("p", odd)


def test_tokens_of_templates():
    t = Tokens('f("a ${g("b ${h()} c")} $d e")', "kotlin")
    assert [x.text for x in t.list if x.kind == "name"] == ["f", "g", "h", "d"]
    t = Tokens("x = `a ${ {k: `in ${y}`} } b` / 2; z = a.b(/[/]`/).c", "typescript")
    assert [x.text for x in t.list if x.kind == "name"] == ["x", "k", "y", "z", "a", "b", "c"] and [x.text for x in t.list if x.kind == "regex"] == ["/[/]`/"]
