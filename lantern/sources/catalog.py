"""The provinces and their regions as tables, and checks of a catalog of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import text

# The provinces in the order of their codes, 01 to 81.
PROVINCES = [
    "Adana", "Adiyaman", "Afyonkarahisar", "Agri", "Amasya", "Ankara", "Antalya", "Artvin", "Aydin", "Balikesir",
    "Bilecik", "Bingol", "Bitlis", "Bolu", "Burdur", "Bursa", "Canakkale", "Cankiri", "Corum", "Denizli",
    "Diyarbakir", "Edirne", "Elazig", "Erzincan", "Erzurum", "Eskisehir", "Gaziantep", "Giresun", "Gumushane", "Hakkari",
    "Hatay", "Isparta", "Mersin", "Istanbul", "Izmir", "Kars", "Kastamonu", "Kayseri", "Kirklareli", "Kirsehir",
    "Kocaeli", "Konya", "Kutahya", "Malatya", "Manisa", "Kahramanmaras", "Mardin", "Mugla", "Mus", "Nevsehir",
    "Nigde", "Ordu", "Rize", "Sakarya", "Samsun", "Siirt", "Sinop", "Sivas", "Tekirdag", "Tokat",
    "Trabzon", "Tunceli", "Sanliurfa", "Usak", "Van", "Yozgat", "Zonguldak", "Aksaray", "Bayburt", "Karaman",
    "Kirikkale", "Batman", "Sirnak", "Bartin", "Ardahan", "Igdir", "Yalova", "Karabuk", "Kilis", "Osmaniye",
    "Duzce",
]
# The regions and their provinces. Two provinces are in none.
REGIONS = {
    "Marmara": [
        "istanbul", "tekirdag", "edirne", "kirklareli", "balikesir", "canakkale", "bursa", "kocaeli", "sakarya", "duzce",
        "bolu", "yalova", "bilecik",
    ],
    "Ege": [
        "izmir", "manisa", "aydin", "denizli", "mugla", "afyonkarahisar", "kutahya", "usak",
    ],
    "Akdeniz": [
        "antalya", "isparta", "burdur", "mersin", "adana", "osmaniye", "hatay", "kahramanmaras",
    ],
    "İç Anadolu": [
        "ankara", "konya", "eskisehir", "aksaray", "karaman", "nigde", "nevsehir", "kirsehir", "kirikkale", "cankiri",
        "kayseri", "sivas",
    ],
    "Karadeniz": [
        "trabzon", "rize", "artvin", "giresun", "ordu", "samsun", "sinop", "kastamonu", "bartin", "zonguldak",
        "karabuk", "amasya", "tokat", "gumushane", "bayburt",
    ],
    "Doğu Anadolu": [
        "erzurum", "erzincan", "malatya", "elazig", "bingol", "tunceli", "van", "mus", "bitlis", "agri",
        "igdir", "ardahan", "kars",
    ],
    "Güneydoğu Anadolu": [
        "gaziantep", "adiyaman", "sanliurfa", "diyarbakir", "mardin", "siirt", "batman", "sirnak", "kilis", "hakkari",
    ],
}
# What a hard issue begins with.
HARD = ["missing_config:", "unknown_config_code:", "invalid_url:"]


def provinces(spark: SparkSession) -> DataFrame:
    """code, name and slug."""
    rows = spark.createDataFrame([(f"{k:02d}", n) for k, n in enumerate(PROVINCES, 1)], "code string, name string")
    return rows.withColumn("slug", text.slugify(F.col("name")))


def regions(spark: SparkSession) -> DataFrame:
    """region, slug and place, the place of the province in its region's list."""
    return spark.createDataFrame([(r, s, k) for r, slugs in REGIONS.items() for k, s in enumerate(slugs)], "region string, slug string, place int")


def same_region(slugs: DataFrame, regions_: DataFrame, most: int = 8) -> DataFrame:
    """Adds region, and near, the first other provinces of it; both are null or empty for a province in no region."""
    of = slugs.join(F.broadcast(regions_.select("slug", "region")), "slug", "left")
    others = regions_.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "slug"))), lambda x: x["slug"]).alias("all"))
    near = F.slice(F.filter("all", lambda x: x != F.col("slug")), 1, most)
    return of.join(F.broadcast(others), "region", "left").withColumn("near", F.coalesce(near, F.array().cast("array<string>"))).drop("all")


def config(asked: DataFrame, catalog: DataFrame, code: str = "code") -> DataFrame:
    """The catalog's row of each asked code, in any case; null columns where there is none."""
    return asked.withColumn("_code", F.lower(F.coalesce(code, F.lit("")))).join(catalog.withColumnRenamed("code", "_code"), "_code", "left").drop("_code")


def bad_url(url: Column) -> Column:
    return ~F.coalesce(url, F.lit("")).rlike("(?i)^https?://")


def issues(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """issue and hard: what is wrong with a catalog (code, format, url) for the known provinces (slug). Codes of a shared
    endpoint come in order; an endpoint is shared by few, so they fit into a text."""
    missing = known.join(catalog, known["slug"] == catalog["code"], "left_anti").select(F.concat(F.lit("missing_config:"), "slug").alias("issue"))
    unknown = catalog.join(known, known["slug"] == catalog["code"], "left_anti").select(F.concat(F.lit("unknown_config_code:"), "code").alias("issue"))
    bad = catalog.where(bad_url(F.col("url"))).select(F.concat_ws(":", F.lit("invalid_url"), "code", "url").alias("issue"))
    shared = catalog.groupBy("format", "url").agg(F.array_sort(F.collect_list("code")).alias("codes")).where("size(codes) > 1")
    shared = shared.select(F.concat(F.lit("shared_endpoint:"), "format", F.lit("::"), "url", F.lit(":"), F.array_join("codes", ",")).alias("issue"))
    hard = F.lit(False)
    for start in HARD:
        hard = hard | F.col("issue").startswith(start)
    return missing.unionByName(unknown).unionByName(bad).unionByName(shared).withColumn("hard", hard)


def ajax_url(html: Column, endpoint: Column, today: Column) -> Column:
    """The address of a page's list of pharmacies as its script builds it, with the day; null if there is none."""
    whole = F.regexp_extract(html, r"""(?i)["'](https?://[^"']+/getPharm(?:acies)?/?)["']\s*\+\s*\w+""", 1)
    path = F.regexp_extract(html, r"""(?i)url\s*=\s*["'](/[^"']*getPharm(?:acies)?/?)["']\s*\+""", 1)
    origin = F.regexp_extract(endpoint, r"(?i)^(https?://[^/?#]+)", 1)
    day = lambda base: F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), today)
    return F.when(whole != "", day(whole)).when((path != "") & (origin != ""), day(F.concat(origin, path)))


def append_query(url: Column, query: Column) -> Column:
    joined = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), query)
    return F.when(F.coalesce(query, F.lit("")) == "", url).otherwise(joined)


def _undotted(path: Column) -> Column:
    """A path from the root with its . and .. steps done; what ends with one is a folder."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.array().cast("array<string>")
    done = F.aggregate(steps, none, lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(none)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    folder = F.element_at(steps, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(done, "/"), F.when(folder & (F.size(done) > 0), "/").otherwise(""))


def resolved(endpoint: Column, action: Column) -> Column:
    """A form's action as a whole address: kept if it has a scheme, else from the root, the query or the folder of the
    endpoint; an empty one is the endpoint. Dots in the path are resolved."""
    origin, page = F.regexp_extract(endpoint, r"(?i)^([a-z]+://[^/?#]+)", 1), F.regexp_extract(endpoint, r"^([^?#]*)", 1)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    made = F.when(action.rlike("(?i)^[a-z][a-z0-9+.-]*:"), action).when(action.startswith("//"), F.concat(F.regexp_extract(endpoint, "(?i)^([a-z]+:)", 1), action))
    at, rest = F.regexp_extract(action, r"^([^?#]*)", 1), F.regexp_extract(action, r"^[^?#]*(.*)$", 1)
    path = F.when(action.startswith("/"), at).otherwise(F.concat(F.substr(folder, F.length(origin) + 1), at))
    made = made.when(action.startswith("?") | action.startswith("#"), F.concat(page, action)).otherwise(F.concat(origin, _undotted(path), rest))
    return F.when(F.coalesce(action, F.lit("")) == "", endpoint).otherwise(made)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; null if there is none."""
    quoted, bare = F.regexp_extract(tag, rf"""(?i){name}\s*=\s*["']([^"']*)["']""", 1), F.regexp_extract(tag, rf"(?i){name}\s*=\s*([^\s>]+)", 1)
    return F.when(tag.rlike(rf"""(?i){name}\s*=\s*["'][^"']*["']"""), quoted).when(bare != "", bare)
