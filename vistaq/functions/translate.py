"""Queries from Portuguese by a dictionary and a memory of earlier translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold

# The scenery dictionary and the words that are dropped.
WORDS = {
    "taverna": "tavern", "estalagem": "inn", "hospedaria": "inn", "masmorra": "dungeon", "calabouco": "dungeon", "cripta": "crypt",
    "castelo": "castle", "fortaleza": "fortress", "forte": "fort", "torre": "tower", "muralha": "wall", "portao": "gate", "ponte": "bridge",
    "templo": "temple", "igreja": "church", "catedral": "cathedral", "capela": "chapel", "santuario": "shrine", "mosteiro": "monastery",
    "altar": "altar", "biblioteca": "library", "laboratorio": "laboratory", "forja": "forge", "ferreiro": "blacksmith", "mercado": "market",
    "feira": "market", "loja": "shop", "armazem": "warehouse", "taberna": "tavern", "padaria": "bakery", "estabulo": "stable",
    "moinho": "mill", "fazenda": "farm", "celeiro": "barn", "vila": "village", "vilarejo": "village", "aldeia": "village",
    "cidade": "city", "povoado": "town", "acampamento": "camp", "porto": "port", "doca": "docks", "cais": "docks", "farol": "lighthouse",
    "navio": "ship", "barco": "boat", "veleiro": "sailing ship", "pirata": "pirate", "naufragio": "shipwreck", "conves": "deck",
    "floresta": "forest", "mata": "woods", "bosque": "grove", "selva": "jungle", "pantano": "swamp", "brejo": "marsh",
    "deserto": "desert", "oasis": "oasis", "duna": "dunes", "montanha": "mountain", "caverna": "cave", "gruta": "cavern",
    "mina": "mine", "penhasco": "cliff", "desfiladeiro": "canyon", "praia": "beach", "ilha": "island", "lago": "lake", "rio": "river",
    "cachoeira": "waterfall", "campo": "field", "planicie": "plains", "tundra": "tundra", "gelo": "ice", "neve": "snow", "vulcao": "volcano",
    "esgoto": "sewer", "cemiterio": "graveyard", "tumba": "tomb", "ruinas": "ruins", "arena": "arena", "coliseu": "colosseum",
    "prisao": "prison", "cadeia": "jail", "cela": "cell", "trono": "throne", "salao": "hall", "palacio": "palace",
    "mansao": "mansion", "casa": "house", "cabana": "cabin", "quarto": "bedroom", "cozinha": "kitchen", "porao": "basement",
    "jardim": "garden", "praca": "square", "rua": "street", "beco": "alley", "inferno": "hell", "abismo": "abyss", "covil": "lair", "toca": "lair",
    "ninho": "nest", "labirinto": "labyrinth", "observatorio": "observatory", "nave": "spaceship", "espacial": "space", "estacao": "station",
    "reator": "reactor", "hangar": "hangar", "oficina": "workshop", "pedra": "stone", "pedras": "stones", "joia": "jewel", "joias": "jewelry",
    "ourives": "jeweler", "relojoeiro": "clockmaker", "alquimista": "alchemist", "boticario": "apothecary", "armeiro": "armorer", "carpinteiro": "carpenter",
    "noite": "night", "dia": "day", "amanhecer": "dawn", "poente": "sunset", "inverno": "winter", "verao": "summer", "outono": "autumn",
    "chuva": "rain", "tempestade": "storm", "nevoa": "fog", "assombrado": "haunted", "assombrada": "haunted",
    "abandonado": "abandoned", "abandonada": "abandoned", "subterraneo": "underground", "subterranea": "underground",
    "antigo": "ancient", "antiga": "ancient", "magico": "magic", "magica": "magic", "sagrado": "sacred", "sagrada": "sacred",
    "sombrio": "dark", "sombria": "dark", "escuro": "dark", "dragao": "dragon", "anao": "dwarven", "elfo": "elven",
    "elfico": "elven", "goblin": "goblin", "orc": "orc", "bruxa": "witch", "mago": "wizard", "feiticeiro": "sorcerer", "vampiro": "vampire",
    "mortos": "undead", "fantasma": "ghost", "demonio": "demon", "batalha": "battle", "guerra": "war", "mapa": "map", "cena": "scene",
    "interior": "interior", "exterior": "exterior", "entrada": "entrance",
}
DROPPED = ("de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas", "com", "sem", "para", "por", "um", "uma", "o", "a", "os", "as", "e")


def by_dictionary(query: Column, words: dict[str, str] = WORDS, dropped=DROPPED) -> Column:
    """A struct (en, missing): known words replaced, dropped words left out, others kept and missing set. The query comes back as it is, if no word is known; missing too, if none is left."""
    known = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    each = F.transform(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), F.btrim(F.lower(fold(w)), F.lit(".,;:!?")).alias("k")))
    kept = F.filter(each, lambda x: ~x.k.isin(*dropped))
    put = F.array_join(F.transform(kept, lambda x: F.coalesce(F.try_element_at(known, x.k), x.w)), " ")
    hit = F.exists(kept, lambda x: F.map_contains_key(known, x.k))
    missing = (F.size(kept) == 0) | F.exists(kept, lambda x: ~F.map_contains_key(known, x.k))
    return F.struct(F.when(hit, put).otherwise(query).alias("en"), missing.alias("missing"))


def with_memory(queries: DataFrame, memory: DataFrame, query: str = "q") -> DataFrame:
    """queries with en and how it came: from memory (pt, en), else a complete dictionary translation, else what the dictionary gives. The last isn't to be remembered, so a translator can still improve on it.

    memory has a row per query; Spark broadcasts it while its size is below the threshold."""
    left = queries.withColumn("_d", by_dictionary(F.col(query)))
    known = memory.select(F.col("pt").alias(query), F.col("en").alias("_m"))
    how = F.when(F.col("_m").isNotNull(), "memory").when(~F.col("_d.missing"), "dictionary").otherwise("fallback")
    return left.join(known, query, "left").withColumn("en", F.coalesce("_m", "_d.en")).withColumn("how", how).drop("_m", "_d")


# What the translator answers with instead of a translation.
REFUSALS = ("MYMEMORY WARNING", "QUERY LENGTH")


def valid_translation(answer: Column) -> Column:
    """What a translator answered, trimmed, or null where it is empty or a warning."""
    text = F.trim(answer)
    refused = F.lit(False)
    for mark in REFUSALS:
        refused = refused | F.contains(F.upper(text), F.lit(mark))
    return F.when((text != "") & ~refused, text)


def to_ask(queries: DataFrame, memory: DataFrame, asked: DataFrame | None = None, query: str = "q") -> DataFrame:
    """(pt): what a translator should be asked, each query once: those that neither the memory nor the whole dictionary answers, and that aren't being asked (pt)."""
    open_ones = with_memory(queries.select(F.trim(query).alias(query)).where(F.col(query) != ""), memory, query).where("how = 'fallback'").select(F.col(query).alias("pt")).distinct()
    return open_ones if asked is None else open_ones.join(asked.select("pt"), "pt", "left_anti")


def remember(memory: DataFrame, queries: DataFrame, answers: DataFrame, query: str = "q") -> DataFrame:
    """The memory (pt, en) with what is certain now: whole dictionary translations of queries, and valid answers (pt, answer, and at if they come with their time: of several the newest counts, else the first by letter) of a translator. What is remembered stays; fallbacks are not remembered, so that they can still be improved on."""
    known = with_memory(queries.select(F.trim(query).alias(query)), memory, query).where("how = 'dictionary'").select(F.col(query).alias("pt"), "en")
    at = F.col("at").cast("double") if "at" in answers.columns else F.lit(None).cast("double")
    told = answers.select(F.trim("pt").alias("pt"), valid_translation(F.col("answer")).alias("en"), at.alias("at")).where("en is not null")
    first = F.struct((-F.col("at")).alias("at"), "en")
    new = known.withColumn("at", F.lit(None).cast("double")).unionByName(told).groupBy("pt").agg(F.min_by("en", first).alias("en"))
    return memory.select("pt", "en").unionByName(new.join(memory.select("pt"), "pt", "left_anti"))
