"""Descriptions composed from a card's name and attributes, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import filled_stripped, first_upper, strip
from cardloom.operators.attributes import parsed, text_of
from cardloom.operators.projections import attribute_label


def has_content(cards: DataFrame) -> DataFrame:
    """Adds has_content: a name, or an attribute that is neither blank nor a dash (in lists a dash counts)."""
    def content(v: Column) -> Column:
        whole = F.schema_of_variant(v)
        texts = F.try_variant_get(v, "$", "array<string>")
        maps = F.try_variant_get(v, "$", "array<map<string,string>>")
        in_maps = F.exists(maps, lambda m: F.exists(F.map_values(m), lambda x: F.coalesce(strip(x), F.lit("null")) != ""))
        in_list = F.coalesce(in_maps, F.exists(texts, lambda x: F.coalesce(strip(x), F.lit("null")) != ""), F.lit(False))
        return F.when(whole.startswith("ARRAY"), in_list).otherwise(~strip(text_of(v)).isin("", "-"))

    named = F.coalesce(filled_stripped(F.col("name")).isNotNull(), F.lit(False))
    return cards.withColumn("has_content", named | F.coalesce(F.exists(F.map_values(parsed(F.col("attributes"))), content), F.lit(False)))


def _join(sep: str, *parts: Column) -> Column:
    """Parts that are there, or null if none is."""
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def compose_description(cards: DataFrame) -> DataFrame:
    """Adds description_new: null where there is nothing to say (no content, or only `name.`)."""
    value = lambda v: F.when(F.schema_of_variant(v) != "VOID", F.nullif(filled_stripped(text_of(v)), F.lit("-")))
    texts = F.transform_values(parsed(F.col("attributes")), lambda _, v: value(v))
    cards = has_content(cards).withColumn("_map", texts).withColumn("_name", F.coalesce(filled_stripped(F.col("name")), F.lit("Questa carta")))
    g = lambda k: F.try_element_at("_map", F.lit(k))
    put = lambda before, k, after="": F.concat(F.lit(before), k if isinstance(k, Column) else g(k), F.lit(after))
    low = lambda k: F.lower(g(k))
    say = lambda *parts: F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    name = F.col("_name")

    cast = _join(", ", put("si lancia come ", low("azione")), F.when(g("azione").isNull(), put("tempo di lancio ", "tempo_lancio")),
                 put("gittata ", "gittata"), put("area ", "area"), put("durata ", "durata"))
    spell = _join(" ", say(name, " è una magia", put(" di ", low("scuola")), put(" di livello ", "livello"), "."), F.concat(first_upper(cast), F.lit(".")),
                  F.when(g("concentrazione").rlike("(?iu)s[ìi]"), "Richiede concentrazione."), put("Infligge ", "danno", "."), g("effetto"))
    weapon = _join(" ", say(name, " è un'arma", put(" ", low("categoria")), put(" che infligge ", "danno"), put(" danni ", low("tipo_danno")), "."),
                   put("Proprietà: ", "proprieta", "."), F.concat(_join(", ", put("Peso ", "peso"), put("costo ", "costo")), F.lit(".")))
    stats = _join(", ", put("CA ", "classe_armatura"), put("", "punti_ferita", " punti ferita"), put("velocità ", "velocita"))
    defence = _join(", ", put("resistenze a ", "resistenze"), put("immunità a ", "immunita"), put("vulnerabilità a ", "vulnerabilita"))
    monster = _join(" ", say(name, " è una temibile creatura", put(" di grado sfida ", "grado_sfida"), "."), put("Possiede ", stats, "."), put("Ha ", defence, "."))
    bio = F.lower(_join(" ", g("razza"), g("classe")))
    health = _join(", ", put("CA ", "classe_armatura"), put("", "punti_ferita", " PF"))
    character = _join(" ", say(name, put(", ", bio), put(" di livello ", "livello"), "."), F.concat(health, F.lit(".")))
    traits = _join(" e ", put("taglia ", low("taglia")), put("velocità ", "velocita"))
    race = _join(" ", F.concat(F.lit("I "), name, F.coalesce(put(" hanno ", traits, "."), F.lit(" sono un popolo dalle antiche origini."))), put("Parlano: ", "linguaggi", "."))
    class_ = _join(" ", say(name, " è una classe", put(" incentrata su ", "abilita_primaria"), "."), put("Dado vita: ", "dado_vita", "."), put("Tiri salvezza: ", "tiri_salvezza", "."))
    feat = _join(" ", F.concat(name, F.lit(" è un talento che conferisce vantaggi unici.")), put("Prerequisito: ", "prerequisito", "."))
    pairs = F.filter(F.transform(F.map_entries("_map"), lambda e: F.concat(attribute_label(e["key"]), F.lit(": "), e["value"])), lambda x: x.isNotNull())
    extra = F.nullif(F.array_join(F.slice(pairs, 1, 6), " · "), F.lit(""))
    other = _join(" ", F.concat(name, F.lit(".")), F.concat(extra, F.lit(".")))

    kind = F.col("type")
    text = F.when(kind == "spell", spell).when(kind == "weapon", weapon).when(kind == "monster", monster).when(kind == "character", character)
    text = text.when(kind == "race", race).when(kind == "class", class_).when(kind == "feat", feat).otherwise(other)
    text = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    good = F.col("has_content") & (text != "") & (text != F.concat(name, F.lit(".")))
    return cards.withColumn("description_new", F.when(good, text)).drop("_map", "_name", "has_content")


def fill_story(cards: DataFrame) -> DataFrame:
    """A blank story becomes the stock sentence."""
    name = F.coalesce(filled_stripped(F.col("name")), F.lit("Questa carta"))
    stock = F.concat(F.lit("Le origini di "), name, F.lit(" si perdono tra le pagine ingiallite di antichi tomi, tramandate da generazioni di avventurieri."))
    return cards.withColumn("story", F.when(filled_stripped(F.col("story")).isNull(), stock).otherwise(F.col("story")))
