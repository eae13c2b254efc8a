"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is a host and the start of a path with a verdict; it fits its host and all subdomains where the url's path starts with
the rule's, and the longest fitting rule decides. Other urls are scored by a model trained at each call from a small labelled
table: the n-grams of the labelled urls are hashed by the same SQL expressions as those of the pages, collected (at most
`most_labelled` rows), and weighted by stochastic gradient descent on the driver. Pages are judged by SQL expressions alone.

Ties: a score of exactly the threshold blocks. Nulls: a null url, or one without "://", has an empty host and path and no features but the bias. Repeated rows are judged
alike; long urls are cut into n-grams in one pass; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The labelled table is made by a rule from words that name kinds of sites and pages in general, in four languages. They are common
# knowledge of such kinds, no list taken from anywhere. Hosts and paths both carry signal: each word of a host stands once with a path of its
# own kind and once with a path that says nothing, each word of a path once more under a host that says nothing.
UNWANTED_HOSTS = (
    "casino poker roulette jackpot slots bingo betting bookmaker wager lottery viagra cialis pharmacy pills pillen pilules pastillas meds steroids"
    " porn xxx sex erotik adult escort camgirls hookup milf nude adserver adclick adtrack banner-ads popunder clicktrack affiliate doubleads"
    " spam linkfarm seo-links backlinks traffic-bot malware trojan keygen crack warez torrent pirate phishing account-verify secure-login payday"
    " fast-loan credit-fix get-rich forex-signals crypto-double replica fake-watches outlet-cheap cheap billig gratis-geld free-gift free-iphone"
    " prize-winner miracle-diet weight-loss hair-growth"
).split()
UNWANTED_PATHS = (
    "bonus jackpot free-spins bet-now odds casino buy-pills cheap-meds viagra no-prescription xxx porn nude sex-cam escort adclick banner popup"
    " click?id redirect?url track.gif affiliate aff_id utm_spam win-prize claim-gift lottery verify-account reset-login download-crack keygen.exe"
    " torrent warez loan-approval payday double-bitcoin get-rich replica discount-outlet lose-weight unsubscribe-spam backlinks"
).split()
ORDINARY_HOSTS = (
    "library bibliothek bibliotheque biblioteca news zeitung journal periodico university universitaet universite universidad school schule ecole"
    " escuela museum musee museo hospital krankenhaus clinic city-council rathaus mairie ayuntamiento government ministry parliament court weather"
    " wetter meteo clima garden garten jardin kitchen kueche cuisine cocina recipes music musik musique musica orchestra theatre theater teatro"
    " cinema film history geschichte histoire historia science forschung recherche ciencia physics chemistry biology mathematics developers"
    " software docs manual wiki encyclopedia dictionary bookstore buchhandlung librairie libreria post railway bahn travel reise voyage viaje"
    " mountain river forest ocean farm market bakery garage architecture design photo gallery football cycling running yoga chess"
    " local regional national family friends community church village energy water climate engineering bank insurance notes blog diary"
).split()
ORDINARY_PATHS = (
    "about ueber-uns a-propos acerca contact kontakt contacto article artikel noticias actualites news archive archiv archivo category kategorie tag"
    " author autor docs guide tutorial reference manual help hilfe aide ayuda faq events termine agenda calendar map karte carte mapa history"
    " geschichte histoire recipe rezept recette receta lesson course cours curso research paper publication press presse gallery album team"
    " careers imprint impressum privacy terms sitemap feed.xml search index"
).split()
FRONTS, ENDS = ("", "www.", "m.", "blog."), (".com", ".net", ".org", ".info")
PLAIN_HOSTS = ("site", "portal", "home", "server", "web", "page")
PLAIN_PATHS = ("", "/", "/index.html", "/en/17", "/de/403.html", "/fr/9?page=2", "/es/1201/", "/page/7#top", "/2024/05/")


def labelled() -> list[tuple[str, int]]:
    """(url, 1 for unwanted) of the table."""
    out = []
    for label, hosts, paths in ((1, UNWANTED_HOSTS, UNWANTED_PATHS), (0, ORDINARY_HOSTS, ORDINARY_PATHS)):
        for i, name in enumerate(hosts):
            site = f"http://{FRONTS[i % len(FRONTS)]}{name}{('', '24', '-online', 's')[i % 4]}.example{ENDS[i // 4 % len(ENDS)]}"
            out.append((f"{site}/{paths[i % len(paths)]}", label))
            out.append((f"{site}{PLAIN_PATHS[i % len(PLAIN_PATHS)]}", label))
        for i, name in enumerate(paths):
            out.append((f"http://{FRONTS[i % len(FRONTS)]}{PLAIN_HOSTS[i % len(PLAIN_HOSTS)]}{i}.example{ENDS[i % len(ENDS)]}/{name}{('', '/', f'/{i}', '.html')[i % 4]}", label))
    return out


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, start = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Distinct buckets of the n-grams of ^host$ and of the path, each kind under its own seed."""

    def hashed(text: Column, n: int, seed: int) -> Column:
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(seed), g), F.lit(buckets)).cast("int"))

    kinds = (F.concat(F.lit("^"), host, F.lit("$")), path)
    return F.array_distinct(F.concat(*(hashed(text, n, seed) for seed, text in enumerate(kinds) for n in sizes)))


def train(rows: list[tuple[list[int], int]], buckets: int, epochs: int = 40, rate: float = 0.5, decay: float = 1e-4, seed: int = 11) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression on features scaled by 1/sqrt(how many a row has)."""
    weights, bias, order = [0.0] * buckets, 0.0, list(range(len(rows)))
    draw = random.Random(seed)
    for epoch in range(epochs):
        draw.shuffle(order)
        step = rate / (1 + 0.05 * epoch)
        for i in order:
            found, label = rows[i]
            scale = 1 / math.sqrt(max(1, len(found)))
            z = bias + scale * sum(weights[f] for f in found)
            error = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += step * error * 0.1
            for f in found:
                weights[f] += step * (error * scale - decay * weights[f])
    return weights, bias


def judge_urls(
    pages: DataFrame, rules: tuple = RULES, known: list[tuple[str, int]] | None = None, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 13,
    threshold: float = 0.5, most_labelled: int = 5000,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id long, url string)."""
    spark = pages.sparkSession
    table = list(labelled() if known is None else known)
    if len(table) > most_labelled:
        raise ValueError(f"the labelled table is to have at most {most_labelled} rows")
    rows = spark.createDataFrame(table, "url string, label int")
    rows = rows.select("url", "label", features(host(F.col("url")), path(F.col("url")), sizes, buckets).alias("f")).orderBy("url")
    weights, bias = train([(list(r["f"]), r["label"]) for r in rows.collect()], buckets)
    table = F.from_json(F.lit(json.dumps([round(w, 6) for w in weights])), "array<double>")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said, "f": features(F.col("host"), F.col("path"), sizes, buckets)})
    total = F.aggregate("f", F.lit(0.0), lambda s, i: s + F.get(table, i))
    z = F.lit(round(bias, 6)) + total / F.sqrt(F.greatest(F.lit(1), F.size("f")))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-z)))
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
