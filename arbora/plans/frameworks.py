"""Queries of framework graphs: applications made of the tables' rows, a file for each region, nation and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges
from ..sources.languages.android import AndroidGraph
from ..sources.languages.fastapi import FastApiGraph
from . import views as V
from .queries import query

_SUPPLIER = ("from fastapi import APIRouter, Depends\nfrom pydantic import BaseModel\nfrom app.nation$1 import guard$1\n\nrouter = APIRouter(prefix='/s$0')\n\n\nclass Supplier$0(BaseModel):\n    name: str\n\n\n"
             "@router.get('/{key}', response_model=Supplier$0)\ndef read$0(key: int, g=Depends(guard$1)):\n    return g\n\n\n@router.post('/', response_model=list[Supplier$0])\nasync def add$0(body: Supplier$0):\n    return body\n")


def _fastapi(spark, sf_dir) -> FastApiGraph:
    """Regions are applications that include the routers of their nations, which include those of their suppliers."""
    t = lambda n: V.table(spark, sf_dir, n)

    def included(rows, key, up, module):
        """For each ``up``: the lines that import its children's routers and that include them."""
        k = F.col(key).cast("string")
        lines = F.struct(F.col(key).alias("k"), F.concat(F.lit(f"from app.{module}"), k, F.lit(" import router as c"), k, F.lit("\n")).alias("first"),
                         F.concat(F.lit("router.include_router(c"), k, F.lit(", prefix='/v', tags=['t"), k, F.lit("'])\n")).alias("second"))
        made = rows.groupBy(F.col(up).alias("up")).agg(F.array_sort(F.collect_list(lines)).alias("m"))
        return made.select("up", F.array_join(F.transform("m", lambda x: x["first"]), "").alias("imports"), F.array_join(F.transform("m", lambda x: x["second"]), "").alias("includes"))
    region = t("region").join(included(t("nation"), "n_nationkey", "n_regionkey", "nation"), F.col("r_regionkey") == F.col("up"), "left")
    nation = t("nation").join(included(t("supplier"), "s_suppkey", "s_nationkey", "supplier"), F.col("n_nationkey") == F.col("up"), "left")
    filled = {"imports": "", "includes": ""}
    files = V._sources(region.fillna(filled), "app/region$0.py", "from fastapi import APIRouter, FastAPI\n$1app = FastAPI(title='R$0')\nrouter = APIRouter(prefix='/r$0')\napp.include_router(router, prefix='/api')\n$2", "r_regionkey", "imports", "includes")
    files = files.unionByName(V._sources(nation.fillna(filled), "app/nation$0.py", "from fastapi import APIRouter, Depends\n$1router = APIRouter(prefix='/n$0')\n$2\n\ndef limit$0():\n    return 1\n\n\ndef guard$0(n=Depends(limit$0)):\n    return n\n", "n_nationkey", "imports", "includes"))
    return FastApiGraph(files.unionByName(V._sources(t("supplier"), "app/supplier$0.py", _SUPPLIER, "s_suppkey", "s_nationkey")))


_PLACES = "s as (select s_suppkey as s, n_nationkey as n, n_regionkey as r from supplier join nation on s_nationkey = n_nationkey)"


@query(f"""with {_PLACES} select 'app_app.region' || r_regionkey || '_app' as id, 'app' as kind, 'R' || r_regionkey as label from region
union all select 'router_app.region' || r_regionkey || '_router', 'router', 'router' from region union all select 'router_app.nation' || n_nationkey || '_router', 'router', 'router' from nation
union all select 'router_app.supplier' || s_suppkey || '_router', 'router', 'router' from supplier
union all select 'ep_app.supplier' || s || '_read' || s || '_GET', 'endpoint', 'GET /api/r' || r || '/v/n' || n || '/v/s' || s || '/{{key}}' from s
union all select 'ep_app.supplier' || s || '_add' || s || '_POST', 'endpoint', 'POST /api/r' || r || '/v/n' || n || '/v/s' || s from s
union all select distinct 'dep_app.nation' || n || '_limit' || n, 'dependency', 'limit' || n from s union all select distinct 'dep_app.nation' || n || '_guard' || n, 'dependency', 'guard' || n from s
union all select 'schema_app.supplier' || s_suppkey || '_Supplier' || s_suppkey, 'schema', 'Supplier' || s_suppkey from supplier""")
def fastapi_nodes(spark, sf_dir):
    """Applications, routers, endpoints with their whole paths, dependencies that an endpoint reaches, and schemas."""
    return _fastapi(spark, sf_dir).nodes().select("id", "kind", "label")


@query(f"""with {_PLACES} select 'app_app.region' || r_regionkey || '_app' as from_id, 'INCLUDES' as relation, 'router_app.region' || r_regionkey || '_router' as to_id from region
union all select 'router_app.region' || n_regionkey || '_router', 'INCLUDES', 'router_app.nation' || n_nationkey || '_router' from nation
union all select 'router_app.nation' || n || '_router', 'INCLUDES', 'router_app.supplier' || s || '_router' from s
union all select 'router_app.supplier' || s || '_router', 'ROUTES', 'ep_app.supplier' || s || '_read' || s || '_GET' from s union all select 'router_app.supplier' || s || '_router', 'ROUTES', 'ep_app.supplier' || s || '_add' || s || '_POST' from s
union all select 'ep_app.supplier' || s || '_read' || s || '_GET', 'DEPENDS_ON', 'dep_app.nation' || n || '_guard' || n from s
union all select distinct 'dep_app.nation' || n || '_guard' || n, 'SUB_DEPENDENCY', 'dep_app.nation' || n || '_limit' || n from s
union all select 'ep_app.supplier' || s || '_add' || s || '_POST', 'REQUEST_BODY', 'schema_app.supplier' || s || '_Supplier' || s from s
union all select 'ep_app.supplier' || s || '_read' || s || '_GET', 'RESPONSE_MODEL', 'schema_app.supplier' || s || '_Supplier' || s from s
union all select 'ep_app.supplier' || s || '_add' || s || '_POST', 'RESPONSE_MODEL', 'schema_app.supplier' || s || '_Supplier' || s from s""")
def fastapi_edges(spark, sf_dir):
    """All edges between components: inclusion, routes, dependencies, bodies and models."""
    graph = _fastapi(spark, sf_dir)
    return edges.valid_edges(graph.edges(), graph.nodes()).select("from_id", "relation", "to_id")


@query(f"""with {_PLACES}, used as (select distinct n from s) select 'dep_app.nation' || n || '_guard' || n as id from used union all select 'dep_app.nation' || n || '_limit' || n from used""")
def active_dependencies(spark, sf_dir):
    """Dependencies that an endpoint reaches; those of nations without suppliers stay out."""
    return _fastapi(spark, sf_dir).active_dependencies().select("id")


_NET = ("package di\n@Module\n@InstallIn(SingletonComponent::class)\nobject NetModule$0 {\n    @Provides\n    fun provideApi$0(): Api$0 = create()\n    @Binds\n    abstract fun bindRepo$0(impl: RepoImpl$0): Repo$0\n}\n"
        "class RepoImpl$0 @Inject constructor(val dao: ItemDao$0) : Repo$0\ninterface Api$0 {\n    @GET(\"items/{id}\")\n    suspend fun items$0(): List<Item$0>\n}\n")
_HOME = ("package ui\n@Composable\nfun HomeScreen$0(viewModel: Home$0ViewModel = hiltViewModel()) {\n    Title$0(\"x\")\n}\n\n@Composable\nprivate fun Title$0(text: String) { Text(text) }\n\n"
         "@HiltViewModel\nclass Home$0ViewModel @Inject constructor(private val repo: Repo$1, private val api: Api$1) : ViewModel() {\n    fun load() { api.items$1() }\n}\n")


@query(f"""with {_PLACES}, home as (select 'ui/Home' || s || '.kt' as h, s, 'di/Net' || n || '.kt' as d, n from s), net as (select 'di/Net' || n_nationkey || '.kt' as d, n_nationkey as n from nation)
select 'composable:' || h || '#HomeScreen' || s as from_id, 'CALLS' as relation, 'composable:' || h || '#Title' || s as to_id from home
union all select 'composable:' || h || '#HomeScreen' || s, 'USES_VIEWMODEL', 'viewmodel:' || h || '#Home' || s || 'ViewModel' from home
union all select 'viewmodel:' || h || '#Home' || s || 'ViewModel', 'INJECTS', 'binding:' || d || '#NetModule' || n || '.bindRepo' || n from home
union all select 'viewmodel:' || h || '#Home' || s || 'ViewModel', 'INJECTS', 'binding:' || d || '#NetModule' || n || '.provideApi' || n from home
union all select 'viewmodel:' || h || '#Home' || s || 'ViewModel', 'CALLS_API', 'api:' || d || '#Api' || n from home
union all select 'module:' || d || '#NetModule' || n, 'PROVIDES', 'binding:' || d || '#NetModule' || n || '.provideApi' || n from net union all select 'module:' || d || '#NetModule' || n, 'BINDS', 'binding:' || d || '#NetModule' || n || '.bindRepo' || n from net
union all select 'module:' || d || '#NetModule' || n, 'INSTALLS_IN', 'component:SingletonComponent' from net union all select 'api:' || d || '#Api' || n, 'ROUTES', 'apiendpoint:' || d || '#Api' || n || '.items' || n from net""")
def android_edges(spark, sf_dir):
    """All edges of an application with a module and an interface for each nation, a screen and its model for each supplier."""
    t = lambda n: V.table(spark, sf_dir, n)
    files = V._sources(t("nation"), "di/Net$0.kt", _NET, "n_nationkey").unionByName(V._sources(t("supplier"), "ui/Home$0.kt", _HOME, "s_suppkey", "s_nationkey"))
    return AndroidGraph(files).edges().select("from_id", "relation", "to_id")
