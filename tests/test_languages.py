"""TypeScript, Kotlin, FastAPI and Android extraction on small projects, and the whole analysis."""

import json

import pytest
from pyspark.sql import functions as F

from arbora.operators.analysis import analyse_files
from arbora.sources.languages import lexing
from arbora.sources.languages.android import AndroidGraph
from arbora.sources.languages.braces import BraceGraph
from arbora.sources.languages.fastapi import FastApiGraph

TS = {
    "src/api/client.ts": "import { Base, helper as h } from './base';\nimport * as util from '../util';\nimport def from './only';\nexport interface Options { url: string; }\nexport class Client extends Base implements Options {\n  url = '/x';\n  constructor(private opts: Options) { super(); }\n  load(id: number): Promise<Options> {\n    this.reset(); // this.nothing()\n    return util.fetchIt(h(id));\n  }\n}\nexport const make = (o: Options) => new Client(o);\nlet counter = 0;\nfunction bump() { counter += 1; def(); }\n",
    "src/api/base.ts": "export class Base { reset() { return 1; } }\nexport function helper(x) { return x; }\n", "src/util/index.ts": "export { deep as fetchIt } from './deep';\nexport * from './deep';\nexport function fetchIt(x) { return lazy(); }\nfunction lazy() { return import('./deep'); }\n", "src/util/deep.js": "export const deep = 1;\n", "src/api/only.ts": "export default function single() {}\n"}
KT = {
    "a/Model.kt": "package a.model\n\ninterface Named\nopen class Base(val id: String)\ndata class User(val name: String, val parent: Base?) : Base(name), Named {\n    val label = \"x\"\n    fun rename(to: String): User {\n        return copy(to)\n    }\n}\nconst val LIMIT = 3\n",
    "a/Use.kt": "package a.use\nimport a.model.User\nimport a.model.*\n\nfun create(n: String): User = User(n, null)\nfun check(u: User): Boolean {\n    val x = LIMIT // rename(u)\n    return u.rename(\"a\") == u\n}\n"}


def graph(spark, files):
    g = BraceGraph(spark.createDataFrame(list(files.items()), "path string, content string"))
    return {r["id"]: r for r in g.nodes().collect()}, {(r["from_id"], r["relation"], r["to_id"]) for r in g.edges().collect()}


def full(text):
    """Lines of start, relation, end; what stands before the first sign of a part is short for the file."""
    return {tuple(line.split()) for line in text.strip().splitlines()}


def test_typescript(spark):
    nodes, edges = graph(spark, TS)
    kinds = {i.partition("#")[2] or i: r["kind"] for i, r in nodes.items()}
    assert kinds == {"ts:src/api/base.ts": "file", "ts:src/api/client.ts": "file", "ts:src/api/only.ts": "file", "ts:src/util/deep.js": "file", "ts:src/util/index.ts": "file", "Base": "class", "Base.reset": "method", "helper": "function", "Client": "class",
                     "Client.constructor": "method", "Client.load": "method", "Client.url": "field", "Options": "interface", "bump": "function", "counter": "constant", "make": "function", "single": "function", "deep": "constant", "fetchIt": "function", "lazy": "function"}
    assert nodes["ts:src/api/client.ts#Client"]["span"]["end_line"] == 12 and nodes["ts:src/util/index.ts"]["flags"] == ["dynamic_import"]
    c, b, i, d = "ts:src/api/client.ts", "ts:src/api/base.ts", "ts:src/util/index.ts", "ts:src/util/deep.js"
    assert edges == full(f"""
        {b} EXPORTS {b}#Base
        {b} EXPORTS {b}#helper
        {b}#Base CONTAINS {b}#Base.reset
        {c} DECLARES {c}#bump
        {c} DECLARES {c}#counter
        {c} EXPORTS {c}#Client
        {c} EXPORTS {c}#Options
        {c} EXPORTS {c}#make
        {c} IMPORTS {b}
        {c} IMPORTS ts:src/api/only.ts
        {c} IMPORTS {i}
        {c} IMPORTS_SYMBOL {b}#Base
        {c} IMPORTS_SYMBOL {b}#helper
        {c}#Client CONTAINS {c}#Client.constructor
        {c}#Client CONTAINS {c}#Client.load
        {c}#Client CONTAINS {c}#Client.url
        {c}#Client IMPLEMENTS {c}#Options
        {c}#Client INHERITS {b}#Base
        {c}#Client.constructor TYPE_USES {c}#Options
        {c}#Client.load CALLS {b}#Base.reset
        {c}#Client.load CALLS {b}#helper
        {c}#Client.load CALLS {i}#fetchIt
        {c}#Client.load TYPE_USES {c}#Options
        {c}#bump CALLS ts:src/api/only.ts#single
        {c}#bump WRITES {c}#counter
        {c}#make INSTANTIATES {c}#Client
        {c}#make TYPE_USES {c}#Options
        ts:src/api/only.ts EXPORTS ts:src/api/only.ts#single
        {d} EXPORTS {d}#deep
        {i} DECLARES {i}#lazy
        {i} EXPORTS {i}#fetchIt
        {i} IMPORTS {d}
        {i} RE_EXPORTS {d}#deep
        {i}#fetchIt CALLS {i}#lazy""")


def test_kotlin(spark):
    nodes, edges = graph(spark, KT)
    m, u = "kotlin:a/Model.kt", "kotlin:a/Use.kt"
    assert nodes[f"{m}#User"]["kind"] == "class" and nodes[f"{m}#Named"]["kind"] == "interface" and nodes[f"{m}#User.name"]["kind"] == "field" and nodes["kotlin-package:a.model"]["kind"] == "module"
    assert nodes[f"{m}#User.rename"]["symbol_path"] == "a/Model.kt:User.rename" and nodes[f"{m}#User"]["provenance"] == "kotlin-core" and f"{m}#LIMIT" not in nodes
    assert edges == full(f"""
        kotlin-package:a.model CONTAINS {m}
        kotlin-package:a.use CONTAINS {u}
        {m} DECLARES {m}#Base
        {m} DECLARES {m}#Named
        {m} DECLARES {m}#User
        {m}#Base CONTAINS {m}#Base.id
        {m}#User CONTAINS {m}#User.label
        {m}#User CONTAINS {m}#User.name
        {m}#User CONTAINS {m}#User.parent
        {m}#User CONTAINS {m}#User.rename
        {m}#User IMPLEMENTS {m}#Named
        {m}#User INHERITS {m}#Base
        {m}#User READS {m}#User.name
        {m}#User TYPE_USES {m}#Base
        {m}#User.parent TYPE_USES {m}#Base
        {m}#User.rename TYPE_USES {m}#User
        {u} DECLARES {u}#check
        {u} DECLARES {u}#create
        {u} IMPORTS {m}
        {u} IMPORTS_SYMBOL {m}#User
        {u}#check CALLS {m}#User.rename
        {u}#check TYPE_USES {m}#User
        {u}#create INSTANTIATES {m}#User
        {u}#create TYPE_USES {m}#User""")


def test_kotlin_names_and_packages(spark):
    nodes, edges = graph(spark, {"a.kt": "class A { fun go() {}\n fun go(x: Int) {} }\nclass B { fun go() {} }\n", "b.kt": "package p\nfun only() {}\n"})
    assert nodes["kotlin-package:<default>"]["kind"] == "module" and ("kotlin-package:<default>", "CONTAINS", "kotlin:a.kt") in edges
    assert nodes["kotlin:a.kt#A.go"]["flags"] == nodes["kotlin:a.kt#B.go"]["flags"] == ["ambiguous_name"] and nodes["kotlin:b.kt#only"]["flags"] == []


def test_masks_keep_places():
    text = 'a /* { */ "b{\\"" // }\n`c{`{}'
    assert len(lexing.mask(text)) == len(text) and "{" not in lexing.mask(text)[:-2] and lexing.Source(text).match == {len(text) - 2: len(text) - 1}
    for odd in ("", "{", "}", '"open', "/* open", "((("):
        lexing.Source(odd)


API = {
    "app/main.py": "from fastapi import FastAPI\nfrom app.api import router as api_router\nfrom app.mw import Log\napp = FastAPI(title='Shop', version='2')\napp.include_router(api_router, prefix='/api')\napp.add_middleware(Log)\n",
    "app/api/__init__.py": "from fastapi import APIRouter\nfrom app.api import users\nrouter = APIRouter()\nrouter.include_router(users.router, prefix='/v1', tags=['v1'])\n",
    "app/api/users.py": "from typing import Annotated\nfrom fastapi import APIRouter, Depends\nfrom app.deps import get_db, CurrentUser\nfrom app.models.user import User\nrouter = APIRouter(prefix='/users', tags=['users'])\n\n@router.get('/me', response_model=User)\ndef me(user: CurrentUser, db=Depends(get_db), q: int = 1):\n    return user\n\n@router.post('/', response_model=list[User])\nasync def add(body: User, db: Annotated[object, Depends(get_db)]):\n    return body\n",
    "app/deps.py": "from typing import Annotated\nfrom fastapi import Depends\nfrom fastapi.security import OAuth2PasswordBearer\noauth = OAuth2PasswordBearer(tokenUrl='t')\ndef get_db():\n    yield 1\ndef get_user(token=Depends(oauth), db=Depends(get_db)):\n    return 1\nCurrentUser = Annotated[object, Depends(get_user)]\n",
    "app/models/user.py": "class User:\n    name: str\n    age: int = 3\n", "tests/test_users.py": "from app.api.users import me\ndef test_me():\n    assert me(1)\n", "conf.yaml": "token_key: 1\n", "app/use.py": "def read():\n    return load('token_key')\n"}


def test_fastapi(spark):
    g = FastApiGraph(spark.createDataFrame(list(API.items()), "path string, content string"))
    nodes = {r["id"]: r for r in g.nodes().collect()}
    assert nodes["ep_app.api.users_me_GET"]["label"] == "GET /api/v1/users/me" and nodes["ep_app.api.users_add_POST"]["label"] == "POST /api/v1/users"
    assert json.loads(nodes["app_app.main_app"]["attrs"])["title"] == "Shop"
    edges = {(r["from_id"], r["relation"], r["to_id"]) for r in g.edges().collect()}
    want = {("app_app.main_app", "INCLUDES", "router_app.api_router"), ("router_app.api_router", "INCLUDES", "router_app.api.users_router"), ("router_app.api.users_router", "ROUTES", "ep_app.api.users_me_GET"), ("app_app.main_app", "MIDDLEWARE_OF", "mw_app.main_Log"),
            ("ep_app.api.users_me_GET", "DEPENDS_ON", "dep_app.deps_get_user"), ("ep_app.api.users_me_GET", "DEPENDS_ON", "dep_app.deps_get_db"), ("ep_app.api.users_add_POST", "DEPENDS_ON", "dep_app.deps_get_db"), ("dep_app.deps_get_user", "SUB_DEPENDENCY", "sec_app.deps_oauth"),
            ("ep_app.api.users_add_POST", "REQUEST_BODY", "schema_app.models.user_User"), ("ep_app.api.users_me_GET", "RESPONSE_MODEL", "schema_app.models.user_User"), ("ep_app.api.users_add_POST", "RESPONSE_MODEL", "schema_app.models.user_User")}
    assert want - edges == set()
    assert {r["tag"] for r in g.stats()["tags"].collect()} == {"users", "v1"}
    assert {r["id"] for r in g.active_dependencies().collect()} == {"sec_app.deps_oauth", "dep_app.deps_get_user", "dep_app.deps_get_db"}


def test_whole_analysis(spark):
    done = analyse_files(spark.createDataFrame(list(API.items()), "path string, content string"), "fastapi")
    edges = {(r["from_id"], r["relation"], r["to_id"]): r for r in done.edges.collect()}
    assert ("ep_app.api.users_me_GET", "IMPLEMENTED_BY", "py:app.api.users#me") in edges and edges["router_app.api.users_router", "ROUTES", "ep_app.api.users_me_GET"]["confidence"] == "framework_inferred"
    assert "fastapi.routes" in edges["router_app.api.users_router", "ROUTES", "ep_app.api.users_me_GET"]["metadata"]
    assert ("py:tests.test_users#test_me", "TESTS", "py:app.api.users#me") in edges
    assert ("config:conf.yaml:1:0:token_key", "CONFIGURES", "py:app.use#read") in edges
    stats = done.stats()
    assert stats["nodes_by_kind"]["endpoint"] == 2 and stats["nodes_by_kind"]["configuration"] == 1 and done.symbols().count() == done.nodes.count()


ANDROID = {
    "ui/Home.kt": "package ui\n@Composable\nfun HomeScreen(viewModel: HomeViewModel = hiltViewModel()) {\n    Title(\"x\")\n}\n\n@Composable\nprivate fun Title(text: String) { Text(text) }\n\n@AndroidEntryPoint\nclass MainActivity : ComponentActivity() {\n    override fun onCreate(b: Bundle?) { setContent { HomeScreen() } }\n}\n\n@HiltViewModel\nclass HomeViewModel @Inject constructor(private val repo: Repo, private val api: Api) : ViewModel() {\n    fun load() { api.items() }\n}\n",
    "di/Net.kt": "package di\n@Module\n@InstallIn(SingletonComponent::class)\nobject NetModule {\n    @Provides\n    fun provideApi(): Api = create()\n    @Binds\n    abstract fun bindRepo(impl: RepoImpl): Repo\n}\nclass RepoImpl @Inject constructor(val dao: ItemDao) : Repo\ninterface Api {\n    @GET(\"items/{id}\")\n    suspend fun items(): List<Item>\n}\n",
    "db/Db.kt": "package db\n@Entity(tableName = \"items\")\ndata class Item(@PrimaryKey val id: Int)\n@Dao\ninterface ItemDao {\n    @Query(\"SELECT * FROM items\")\n    fun all(): List<Item>\n    @Insert\n    fun add(i: Item)\n}\n@Database(entities = [Item::class], version = 1)\nabstract class AppDb : RoomDatabase() {\n    abstract fun dao(): ItemDao\n}\n"}


def test_android(spark):
    g = AndroidGraph(spark.createDataFrame(list(ANDROID.items()), "path string, content string"))
    nodes = {r["id"]: r for r in g.nodes().collect()}
    assert {r["kind"] for r in nodes.values()} == {"composable", "screen", "viewmodel", "module", "binding", "component", "api", "endpoint", "entity", "dao", "query", "database"}
    edges = {(r["from_id"], r["relation"], r["to_id"]) for r in g.edges().collect()}
    home, vm, module = "composable:ui/Home.kt#HomeScreen", "viewmodel:ui/Home.kt#HomeViewModel", "module:di/Net.kt#NetModule"
    want = {(home, "CALLS", "composable:ui/Home.kt#Title"), (home, "USES_VIEWMODEL", vm), (module, "PROVIDES", "binding:di/Net.kt#NetModule.provideApi"), (module, "BINDS", "binding:di/Net.kt#NetModule.bindRepo"), (module, "INSTALLS_IN", "component:SingletonComponent"),
            (vm, "INJECTS", "binding:di/Net.kt#NetModule.bindRepo"), (vm, "INJECTS", "binding:di/Net.kt#NetModule.provideApi"), (vm, "CALLS_API", "api:di/Net.kt#Api"), ("api:di/Net.kt#Api", "ROUTES", "apiendpoint:di/Net.kt#Api.items"),
            ("dao:db/Db.kt#ItemDao", "ROUTES", "query:db/Db.kt#ItemDao.all"), ("query:db/Db.kt#ItemDao.all", "QUERIES", "entity:db/Db.kt#Item"), ("database:db/Db.kt#AppDb", "CONTAINS", "dao:db/Db.kt#ItemDao"), ("database:db/Db.kt#AppDb", "DEFINES_ENTITY", "entity:db/Db.kt#Item"),
            ("screen:ui/Home.kt#MainActivity", "HOSTS", home)}
    assert want - edges == set()
    without = {r["relation"] for r in g.edges(False).collect()}
    assert "QUERIES" not in without and "DEFINES_ENTITY" not in without


@pytest.mark.parametrize("what", ["python", "typescript", "kotlin", "android"])
def test_analysis_of_nothing(spark, what):
    done = analyse_files(spark.createDataFrame([("x.txt", "a"), ("y.py", None)], "path string, content string"), what)
    assert done.nodes.count() == 0 and done.edges.count() == 0


def test_streaming(spark, tmp_path):
    from arbora.streaming import changes

    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "path string, content string, changed_at timestamp"
    first = spark.sql("select 'a' path, 'one' content, timestamp'2024-01-01 00:00:00' changed_at union all select 'b', 'x', timestamp'2024-01-01 00:01:00'")
    first.write.parquet(str(source / "1"))
    extract = lambda files: files.select("path", F.length("content").alias("n"))

    def pump():
        q = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source)).writeStream.foreachBatch(changes.refresh(extract, out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    pump()
    spark.sql("select 'a' path, 'three' content, timestamp'2024-01-02 00:00:00' changed_at").write.parquet(str(source / "2"))
    pump()
    assert {(r["path"], r["n"]) for r in changes.current_facts(spark, out).collect()} == {("a", 5), ("b", 1)}
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    q = changes.changes_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sorted(r["n_changes"] for r in spark.table("windows").collect()) == [1, 2]
