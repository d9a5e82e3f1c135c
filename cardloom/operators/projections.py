"""Column-wise operators: conforming, redacting, labels, links, flags and prompts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.text import filled, filled_stripped, instant, lookup, url_encoded

# Labels of card types in the interface and in prompts, labels of attributes, file types.
TYPE_LABELS = {
    "spell": "Magia", "class": "Classe", "race": "Razza", "weapon": "Arma", "feat": "Talento", "monster": "Mostro",
    "character": "Personaggio", "custom": "Personalizzato",
}
PROMPT_LABELS = {
    "spell": "Magia/Incantesimo", "class": "Classe", "race": "Razza", "weapon": "Arma", "feat": "Talento",
    "monster": "Mostro/Nemico", "character": "Personaggio", "custom": "Tipo personalizzato",
}
ATTRIBUTE_LABELS = {
    "livello": "Livello", "scuola": "Scuola", "azione": "Azione", "tempo_lancio": "Tempo di lancio", "gittata": "Gittata",
    "area": "Area", "componenti": "Componenti", "durata": "Durata", "concentrazione": "Concentrazione", "danno": "Danno",
    "effetto": "Effetto", "dado_vita": "Dado vita", "abilita_primaria": "Abilità primaria", "tiri_salvezza": "Tiri salvezza",
    "competenze": "Competenze", "caratteristiche": "Caratteristiche", "bonus_caratteristiche": "Bonus caratteristiche",
    "velocita": "Velocità", "taglia": "Taglia", "linguaggi": "Linguaggi", "tratti": "Tratti", "tipo_danno": "Tipo di danno",
    "proprieta": "Proprietà", "peso": "Peso", "costo": "Costo", "categoria": "Categoria", "prerequisito": "Prerequisito",
    "benefici": "Benefici", "classe_armatura": "Classe Armatura (CA)", "punti_ferita": "Punti Ferita (PF)", "for": "FOR",
    "des": "DES", "cos": "COS", "int": "INT", "sag": "SAG", "car": "CAR", "resistenze": "Resistenze",
    "vulnerabilita": "Vulnerabilità", "immunita": "Immunità", "sensi": "Sensi", "grado_sfida": "Grado Sfida", "azioni": "Azioni",
    "classe": "Classe", "razza": "Razza", "bonus_competenza": "Bonus competenza", "cd_incantesimi": "CD incantesimi",
    "abilita_sottoclasse": "Abilità sottoclasse", "slot_incantesimi": "Slot incantesimi", "nome": "Nome",
    "descrizione": "Descrizione", "totale": "Totale", "usati": "Usati",
}
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}

_OBJECT = {"nome": "", "descrizione": ""}

# The empty attributes of each card type, in order.
TEMPLATES = {
    "spell": {
        "livello": "", "scuola": "", "azione": "", "tempo_lancio": "", "gittata": "", "area": "", "componenti": "", "durata": "",
        "concentrazione": "", "danno": "", "effetto": "",
    },
    "class": {"dado_vita": "", "abilita_primaria": "", "tiri_salvezza": "", "competenze": "", "caratteristiche": []},
    "race": {"bonus_caratteristiche": "", "velocita": "", "taglia": "", "linguaggi": "", "tratti": []},
    "weapon": {"danno": "", "tipo_danno": "", "proprieta": "", "peso": "", "costo": "", "categoria": ""},
    "feat": {"prerequisito": "", "benefici": []},
    "monster": {
        "classe_armatura": "", "punti_ferita": "", "velocita": "", "for": "", "des": "", "cos": "", "int": "", "sag": "", "car": "",
        "tiri_salvezza": "", "resistenze": "", "vulnerabilita": "", "immunita": "", "sensi": "", "linguaggi": "", "grado_sfida": "",
        "azioni": [_OBJECT],
    },
    "character": {
        "classe": "", "razza": "", "livello": "", "for": "", "des": "", "cos": "", "int": "", "sag": "", "car": "", "bonus_competenza": "",
        "classe_armatura": "", "punti_ferita": "", "cd_incantesimi": "", "competenze": "", "abilita_sottoclasse": [], "slot_incantesimi": [],
    },
    "custom": {},
}
# What a text prompt shows instead of an empty field.
PROMPT_SEEDS = {
    "spell": {
        "azione": "(Azione, Azione bonus o Reazione)", "area": "(es. Sfera 6 m, oppure - se a bersaglio singolo)", "concentrazione": "(Sì o No)",
        "danno": "(es. 8d6 fuoco, oppure - se non infligge danni)",
    },
    "class": {"caratteristiche": ["tratto1", "tratto2"]},
    "race": {"tratti": ["tratto1", "tratto2"]},
    "feat": {"benefici": ["beneficio1", "beneficio2"]},
    "character": {"abilita_sottoclasse": ["abilita1"], "slot_incantesimi": [{"livello": 1, "totale": 2}]},
    "custom": {"campo1": "", "campo2": ""},
}


def template_json(card_type: str) -> str:
    """The empty attributes of a card type, as JSON text in key order."""
    return json.dumps(TEMPLATES[card_type], ensure_ascii=False, separators=(",", ":"))


def prompt_schema(card_type: str) -> str:
    """The attribute template that a text prompt asks for."""
    shown = TEMPLATES[card_type] | PROMPT_SEEDS.get(card_type, {})
    return f'"attributes": {json.dumps(shown, ensure_ascii=False)}'


def _conformed(source: Column | None, kind: T.DataType | None, target: T.DataType, default) -> Column:
    """A value of type kind as the declared type: structs field by field, arrays and maps value by value."""
    if isinstance(target, T.StructType):
        known = {f.name: f.dataType for f in kind} if isinstance(kind, T.StructType) else {}
        inner = default or {}
        return F.struct(*(_conformed(source[f.name] if f.name in known else None, known.get(f.name), f.dataType, inner.get(f.name)).alias(f.name) for f in target))
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(target, T.ArrayType) and isinstance(kind, T.ArrayType) and isinstance(target.elementType, nested):
        return F.transform(source, lambda x: F.when(x.isNotNull(), _conformed(x, kind.elementType, target.elementType, default)))
    if isinstance(target, T.MapType) and isinstance(kind, T.MapType) and isinstance(target.valueType, nested):
        return F.transform_values(source, lambda _, x: F.when(x.isNotNull(), _conformed(x, kind.valueType, target.valueType, default)))
    value = (F.lit(None) if source is None else source).cast(target)
    return value if default is None or isinstance(target, nested) else F.coalesce(value, F.lit(default).cast(target))


def conform(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Exactly the declared columns: unknown ones go, missing ones come as null, nulls take their default.

    The same holds for fields inside structs, and inside structs that lists and maps hold: their defaults are those of the
    list or map. A null item stays null."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(_conformed(F.col(f"`{f.name}`") if f.name in kinds else None, kinds.get(f.name), f.dataType, defaults.get(f.name)).alias(f.name) for f in schema))


def redact(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def type_label(which: str = "interface") -> Column:
    table = TYPE_LABELS if which == "interface" else PROMPT_LABELS
    named = (F.col("type") == "custom") & filled(F.col("custom_type")).isNotNull()
    return F.when(named, F.col("custom_type")).otherwise(F.coalesce(lookup(table, F.col("type")), F.col("type")))


def with_type_label(df: DataFrame, which: str = "interface") -> DataFrame:
    return df.withColumn("type_label", type_label(which))


def attribute_label(key: Column) -> Column:
    return F.coalesce(lookup(ATTRIBUTE_LABELS, key), F.replace(key, F.lit("_"), F.lit(" ")))


def with_attr_label(df: DataFrame, key_column: str) -> DataFrame:
    return df.withColumn("label", attribute_label(F.col(key_column)))


def with_content_type(df: DataFrame) -> DataFrame:
    """extension and content_type from original_filename; declared_type is used where the extension says nothing."""
    dotted = F.instr("original_filename", ".") > 0
    extension = F.when(dotted, F.lower(F.substring_index("original_filename", ".", -1))).otherwise("png")
    df = df.withColumn("extension", extension)
    return df.withColumn("content_type", F.coalesce(lookup(MIME_TYPES, F.col("extension")), filled(F.col("declared_type")), F.lit("application/octet-stream")))


def with_storage_path(df: DataFrame, kind: str, app: str = "cards") -> DataFrame:
    """<app>/<kind>/<owner>/<id>.<extension>; generated art is png if its MIME type says so, else jpg."""
    extension = F.col("extension") if kind == "uploads" else F.when(F.col("content_type").contains("png"), "png").otherwise("jpg")
    return df.withColumn("storage_path", F.concat(F.lit(f"{app}/{kind}/"), F.col("user_id"), F.lit("/"), F.col("id"), F.lit("."), extension))


def with_links(df: DataFrame, base: str) -> DataFrame:
    """Private and public artwork links (null without artwork) and the public link of the card."""
    art = filled(F.col("artwork_path"))
    return df.withColumns({
        "private_url": F.concat(F.lit(f"{base}/api/files/"), art, F.lit("?auth="), url_encoded(F.coalesce("token", F.lit("")))),
        "public_url": F.concat(F.lit(f"{base}/api/public/artwork/"), art),
        "card_url": F.concat(F.lit(f"{base}/card/"), F.col("id")),
    })


def premium(as_of: str) -> Column:
    until = F.coalesce(instant(F.col("premium_until")) > F.lit(as_of).cast("timestamp"), F.lit(False))
    return F.coalesce(F.col("premium_manual"), F.lit(False)) | until


def with_premium(df: DataFrame, as_of: str) -> DataFrame:
    """Granted by hand, or paid until strictly after as_of."""
    return df.withColumn("is_premium", premium(as_of))


def with_entitlement_label(df: DataFrame) -> DataFrame:
    return df.withColumn("entitlement", F.when(F.coalesce("premium_manual", F.lit(False)), "manual").when(F.col("is_premium"), "subscribed").otherwise("none"))


def with_expiry(df: DataFrame, issued: str = "issued_at", days: int = 7) -> DataFrame:
    return df.withColumn("expires_at", F.col(issued) + F.make_dt_interval(F.lit(days)))


def build_text_prompts(df: DataFrame) -> DataFrame:
    """system_prompt and user_prompt of each request (type, custom_type, language, prompt)."""
    lang = F.when(F.col("language") == "it", "italiano").otherwise("inglese")
    fields = F.coalesce(lookup({t: prompt_schema(t) for t in TEMPLATES}, F.col("type")), F.lit(prompt_schema("custom")))
    return df.withColumns({
        "system_prompt": F.format_string(
            "Sei un maestro creatore di contenuti per Dungeons & Dragons 5e. Genera contenuti coerenti, bilanciati e in lingua %s. "
            "Rispondi SEMPRE ed ESCLUSIVAMENTE con un oggetto JSON valido, senza testo aggiuntivo, senza markdown, senza ```.", lang),
        "user_prompt": F.format_string(
            "Crea una carta di tipo '%s' per D&D basata su questa richiesta: \"%s\".\n"
            "Restituisci un JSON con questa struttura esatta (in %s):\n"
            '{"name": "nome della carta", "description": "descrizione evocativa (max 3 frasi)", "story": "breve storia/lore (max 4 frasi)", %s}\n'
            "Compila tutti i campi con valori realistici e coerenti con le regole D&D 5e. Le liste devono contenere elementi pertinenti.",
            type_label("prompt"), F.col("prompt"), lang, fields),
    })


def build_image_prompts(df: DataFrame) -> DataFrame:
    """image_prompt of each request; its subject is the prompt, else the name, else the description, else the row goes."""
    subject = F.coalesce(*(filled_stripped(F.col(c)) for c in ("prompt", "name", "description")))
    hint = lookup(PROMPT_LABELS, F.col("type"))
    return df.withColumn("image_prompt", F.concat(
        F.lit("Epic dark fantasy trading card artwork, Dungeons and Dragons style, for: "), subject, F.lit(". "),
        F.coalesce(F.concat(F.lit("Subject category: "), hint, F.lit(". ")), F.lit("")),
        F.lit("Highly detailed digital painting, dramatic lighting, obsidian and antique gold and crimson palette, "
              "ornate, cinematic, no text, no borders, no watermark, portrait orientation."),
    )).filter(F.col("image_prompt").isNotNull())


def with_default_attributes(df: DataFrame) -> DataFrame:
    """Rows without attributes get the empty template of their type (an unknown type: no keys)."""
    template = F.coalesce(lookup({t: template_json(t) for t in TEMPLATES}, F.col("type")), F.lit("{}"))
    return df.withColumn("attributes", F.coalesce(filled(F.col("attributes")), template))


def with_token(df: DataFrame) -> DataFrame:
    """The credential of a request: a non-empty cookie, else what follows `Bearer `."""
    header = F.when(F.col("authorization").startswith("Bearer "), F.substr("authorization", F.lit(8)))
    return df.withColumn("token", F.coalesce(filled(F.col("cookie")), header))
