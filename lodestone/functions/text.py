"""Column functions on text: cleaning, tokens, snippets, salvage of values from model output. No UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of packed evidence, stopwords of the ranking tokenizer, markers of speakers.
WINDOW_SEP, TURN_SEP, UTTERANCE_SEP = " [WINDOW_SEP] ", " [TURN_SEP] ", " [UTT_SEP] "
STOPWORDS = "a an and are be been being did do does for in is of on or the to was were with".split()
INTERVIEWER_MARKS = ("ellie", "interviewer", "therapist", "clinician", "doctor", "agent", "system")
PARTICIPANT_MARKS = ("participant", "subject", "patient", "client", "user")
#: The reply patterns of the salvage functions below are fixed values, too: what they find is what counts as an answer.
#: Column names to look for, first come first served.
TEXT_COLUMNS = ["Text", "text", "Utterance", "utterance", "Value", "value", "transcript_text"]
SPEAKER_COLUMNS = ["Speaker", "speaker", "Role", "role", "speaker_role", "Participant", "participant"]


def participant_id(c: Column) -> Column:
    """Trimmed text without a trailing `.0`; null stays null."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def collapse(c: Column) -> Column:
    """Any run of white space becomes a space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_transcript(c: Column) -> Column:
    """Without [..] and (..) annotations, white space collapsed; null becomes empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[.*?\]", " "), r"\(.*?\)", " ")
    return collapse(bare)


def is_participant(c: Column) -> Column:
    """True, false or null (unknown) by markers in the speaker's name; an interviewer marker wins."""
    name = F.lower(F.trim(c))
    has = lambda marks: reduce(lambda a, b: a | b, (F.contains(name, F.lit(m)) for m in marks))
    return F.when(has(INTERVIEWER_MARKS), False).when(has(PARTICIPANT_MARKS), True)


def tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-cased words of a-z, 0-9 and apostrophes, repeats kept; stopwords taken out if given."""
    out = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(out, lambda x: ~x.isin(stopwords)) if stopwords else out


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))


def join_nonblank(parts: Column, sep: str) -> Column:
    """Trimmed parts that aren't blank, joined."""
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), sep)


def split_packed(c: Column, sep: str) -> Column:
    """What join_nonblank() put together, as a list."""
    pattern = sep.strip().replace("[", r"\[").replace("]", r"\]")
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def readable_evidence(c: Column) -> Column:
    """Separators as ` /// ` and `; `, white space collapsed."""
    return collapse(F.replace(F.replace(c, F.lit(WINDOW_SEP.strip()), F.lit(" /// ")), F.lit(TURN_SEP.strip()), F.lit("; ")))


def snippets(c: Column, most: int = 3, longest: int = 240) -> Column:
    """The first snippets of an evidence text, turns parted by `; `, each cut to a length."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\[WINDOW_SEP\]|///"), readable_turns), lambda x: x != "")
    return F.transform(F.slice(parts, 1, most), lambda x: F.substring(x, 1, longest))


def numbered_excerpts(json: Column) -> Column:
    """A JSON list of texts as `Excerpt i: ...` lines; numbers count blank ones too. Not a list: readable text."""
    listed = F.try_parse_json(json)
    items = F.from_json(F.when(F.schema_of_variant(listed).startswith("ARRAY"), json), "array<string>")
    lines = F.transform(items, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit("Excerpt "), (i + 1).cast("string"), F.lit(": "), readable_turns(x))))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), readable_evidence(json))


def readable_turns(c: Column) -> Column:
    return collapse(F.replace(c, F.lit(TURN_SEP.strip()), F.lit("; ")))


def json_list(c: Column) -> Column:
    """A JSON list of strings; an empty list for anything else."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def word_hit(text: Column, terms: Column) -> Column:
    """Whether any term occurs: several words anywhere, a single word between word boundaries."""
    quote = lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    low = F.lower(text)
    return F.exists(terms, lambda t: F.when(F.instr(t, " ") > 0, F.contains(low, t)).otherwise(F.regexp_like(low, F.concat(F.lit(r"\b"), quote(t), F.lit(r"\b")))))


def substring_hits(text: Column, terms: Column) -> Column:
    """The terms that the lower-cased text contains, in the terms' order."""
    return F.filter(terms, lambda t: F.contains(F.lower(text), t))


def head_tail(words: Column, budget: int) -> Column:
    """The first half and the last half of a list that is over budget; the whole list if it fits."""
    head, tail = budget // 2, budget - budget // 2
    return F.when(F.size(words) <= budget, words).otherwise(F.concat(F.slice(words, 1, head), F.slice(words, -tail, tail)))


def salvage_judgment(raw: Column) -> Column:
    """struct(status, severity_hint, reason) of a reply.

    If its JSON object reads and names a known status, all three come from there (a hint outside 0..3 is
    null, the reason is cut at 120). Else a pattern finds status and hint, and the reason says so.
    Else both are null.
    """
    known = ("supports", "against", "ambiguous", "none")
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    read = F.from_json(F.when(body != "", body), "status string, severity_hint string, reason string")
    status = F.lower(F.trim(read["status"]))
    found = F.lower(F.regexp_extract(raw, r'(?i)"?status"?\s*[:=]\s*"?(supports|against|ambiguous|none)', 1))
    hint = read["severity_hint"].try_cast("double").cast("int")
    by_pattern = F.regexp_extract(raw, r'(?i)"?severity_hint"?\s*[:=]\s*"?([0-3])', 1).try_cast("int")
    parsed = F.coalesce(status.isin(*known), F.lit(False))
    return F.struct(
        F.when(parsed, status).when(found != "", found).alias("status"),
        F.when(parsed, F.when(hint.between(0, 3), hint)).when(found != "", by_pattern).alias("severity_hint"),
        F.when(parsed, F.substring(F.coalesce(read["reason"], F.lit("")), 1, 120)).when(found != "", "[regex-parsed]").otherwise("[unparseable]").alias("reason"),
    )


def salvage_set_judgment(raw: Column) -> Column:
    """struct(status, severity_hint, reason) of a reply about a whole list of windows.

    As salvage_judgment(), but a hint counts only if it is a JSON number (its fraction is cut, true is 1), the
    reason isn't cut, and what is found by pattern has a status alone.
    """
    known = ("supports", "against", "ambiguous", "none")
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    text = F.when(body != "", body)
    read = F.from_json(text, "status string, reason string")
    number = F.coalesce(F.from_json(text, "severity_hint double")["severity_hint"], F.from_json(text, "severity_hint boolean")["severity_hint"].cast("double")).try_cast("int")
    status = F.lower(F.trim(read["status"]))
    found = F.lower(F.regexp_extract(raw, r'(?i)"?status"?\s*[:=]\s*"?(supports|against|ambiguous|none)', 1))
    parsed = F.coalesce(status.isin(*known), F.lit(False))
    return F.struct(
        F.when(parsed, status).when(found != "", found).alias("status"),
        F.when(parsed & number.between(0, 3), number).alias("severity_hint"),
        F.when(parsed, F.coalesce(read["reason"], F.lit(""))).when(found != "", "[unparsed reason]").otherwise("[unparseable output]").alias("reason"),
    )


def salvage_relevant(raw: Column) -> Column:
    """true/false of a JSON `relevant`, a boolean or a text that starts with t, else of a bare one by pattern; null if there is none."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    read = F.lower(F.trim(F.from_json(F.when(body != "", body), "relevant string")["relevant"]))
    found = F.lower(F.regexp_extract(raw, r'(?i)"?relevant"?\s*[:=]\s*(true|false)', 1))
    return F.coalesce(read.startswith("t"), F.when(found != "", found == "true"))


def salvage_label(raw: Column) -> Column:
    """0..3 from a `label` value, else from the first bare digit; null if there is none."""
    by_key = F.regexp_extract(raw, r'(?i)"?label"?\s*[:=]\s*"?([0-3])', 1)
    bare = F.regexp_extract(raw, r"\b([0-3])\b", 1)
    return F.coalesce(F.when(by_key != "", by_key), F.when(bare != "", bare)).cast("int")


def staged_scores(raw: Column) -> Column:
    """map<item, score> of a staged reply: confident, then difficult, then scores; the last one wins.

    Keys count by their digits; scores outside 0..3 are dropped.
    """
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    read = F.from_json(F.when(body != "", body), "confident map<string,string>, difficult map<string,string>, scores map<string,string>")
    parts = [F.coalesce(F.map_entries(read[k]), F.array().cast("array<struct<key:string,value:string>>")) for k in ("confident", "difficult", "scores")]
    entries = F.transform(F.concat(*parts), lambda e: F.struct(F.regexp_replace(e["key"], r"\D", "").alias("key"), e["value"].try_cast("int").alias("value")))
    good = F.filter(entries, lambda e: (e["key"] != "") & e["value"].between(0, 3))
    keys = F.array_distinct(F.transform(good, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(good, lambda e: e["key"] == k), -1)["value"]))


def difficult_items(raw: Column) -> Column:
    """Items a staged reply calls difficult and not confident, by their digits, sorted."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    read = F.from_json(F.when(body != "", body), "confident map<string,string>, difficult map<string,string>")
    digits = lambda m: F.transform(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), lambda k: F.regexp_replace(k, r"\D", ""))
    return F.array_sort(F.array_except(digits(read["difficult"]), digits(read["confident"])))


def transcript_scores(raw: Column, items: int = 8) -> Column:
    """array of struct(item_id, label, reasoning) for items 1..items of a reply that rates all of them.

    The reply's object holds a list `scores` of objects, or has item numbers as keys with a label or an
    object each. Of several entries of an item the last counts; what is no label 0..3 is null. Items
    without an entry have a null label and no reasoning.
    """
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    text = F.when(body != "", body)
    listed = F.from_json(text, "scores array<string>")["scores"]
    keyed = F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.regexp_like(e["key"], F.lit(r"^\d+$")))
    entry = "id string, label string, reasoning string"

    def of_list(x: Column) -> Column:
        o = F.from_json(x, entry)
        return F.struct(o["id"].try_cast("double").cast("int").alias("id"), o["label"].alias("label"), o["reasoning"].alias("reasoning"))

    def of_key(e: Column) -> Column:
        o = F.from_json(F.when(F.startswith(F.trim(e["value"]), F.lit("{")), e["value"]), entry)
        own = F.coalesce(o["id"], e["key"]).try_cast("int")
        return F.struct(own.alias("id"), F.when(o.isNotNull(), o["label"]).otherwise(e["value"]).alias("label"), o["reasoning"].alias("reasoning"))

    found = F.coalesce(F.when(listed.isNotNull(), F.transform(listed, of_list)).otherwise(F.transform(keyed, of_key)), F.array().cast("array<struct<id:int,label:string,reasoning:string>>"))

    def item(i: Column) -> Column:
        own = F.element_at(F.concat(F.array(F.lit(None).cast("struct<id:int,label:string,reasoning:string>")), F.filter(found, lambda e: e["id"] == i)), -1)
        number = own["label"].try_cast("double").cast("int")
        digit = F.regexp_extract(F.coalesce(own["label"], F.lit("")), "[0-3]", 0)
        label = F.when(number.isNotNull(), F.when(number.between(0, 3), number)).when(digit != "", digit.cast("int"))
        return F.struct(i.alias("item_id"), label.alias("label"), F.coalesce(own["reasoning"], F.lit("")).alias("reasoning"))

    return F.transform(F.sequence(F.lit(1), F.lit(items)), item)


def term_lists(raw: Column) -> Column:
    """struct(lay, clinical) of a reply's lists, lower-cased and trimmed, without blank ones; null if nothing reads."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    read = F.from_json(F.when(body != "", body), "lay array<string>, clinical array<string>, _corrupt_record string")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.trim(F.lower(t))), lambda t: t != "")
    return F.when((body != "") & read["_corrupt_record"].isNull(), F.struct(clean(read["lay"]).alias("lay"), clean(read["clinical"]).alias("clinical")))


def highlighted(text: Column, terms: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Escaped text with every term marked, whatever its case, longer terms first."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = F.transform(terms, lambda t: F.regexp_replace(escape(t), r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    ordered = F.transform(F.array_sort(F.transform(quoted, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    return F.when(F.size(terms) > 0, F.regexp_replace(escape(text), F.concat(F.lit("(?i)("), F.array_join(ordered, "|"), F.lit(")")), F.lit(f"{before}$1{after}"))).otherwise(escape(text))


# What runs are called by the names of their data sets, columns, models, losses and folders.
FAMILIES = {
    "cv/seedconf_": "Multi-seed confirmation (CORN×Hybrid, 5 seeds)",
    "cv/ctxm_": "MentalBERT context-window matrix",
    "cv/ctx_": "BERT context-window matrix",
    "cv/bm25base_": "Unified BM25 baseline (BERT vs MentalBERT)",
    "cv/": "Original CV (TF-IDF baseline)",
    "sweep_": "MentalBERT LR×epoch sweep",
    "seeds_": "Multi-seed weighted-CE (TF-IDF)",
}
OTHER_FAMILY = "Single split (val/test)"
LOSSES = {"CORN": "CORN", "weighted": "weighted CE"}
OTHER_LOSS = "plain CE"
MODELS = {"mental": "MentalBERT"}
OTHER_MODEL = "BERT"


def named_by(name: Column, names: dict[str, str], other: str, prefix: bool = False) -> Column:
    """The label of the first of names that is in `name`, or that it starts with."""
    out = None
    for part, label in names.items():
        met = F.startswith(name, F.lit(part)) if prefix else F.contains(name, F.lit(part))
        out = F.when(met, label) if out is None else out.when(met, label)
    return out.otherwise(other)


def experiment_family(run: Column, families: dict[str, str] = FAMILIES, other: str = OTHER_FAMILY) -> Column:
    """The family that a run's folder and prefix stand for; longer prefixes come first."""
    return named_by(run, dict(sorted(families.items(), key=lambda x: -len(x[0]))), other, prefix=True)


def evidence_kind(method: Column, dataset: Column) -> Column:
    """Short label of a run's evidence: its retrieval_method() and the window size in its data set's name."""
    wide = F.when(F.contains(dataset, F.lit("w3")), "W3").otherwise("W5")
    return (
        F.when(F.contains(method, F.lit("first-K")), "Plain (no-retrieval utt)")
        .when(F.startswith(method, F.lit("TF-IDF")), "TF-IDF utt")
        .when(F.startswith(method, F.lit("BM25 (utt")), "BM25 utt")
        .when(F.startswith(method, F.lit("BM25")) & F.contains(method, F.lit("context windows")), F.concat(F.lit("BM25 "), wide))
        .when(F.contains(method, F.lit("Hybrid")), F.concat(F.lit("Hybrid "), wide))
        .otherwise("other")
    )


def retrieval_method(dataset: Column, column: Column) -> Column:
    """How a run's evidence was found, from the names of its data set and of its evidence column; its labels are fixed values."""
    name = F.element_at(F.split(dataset, "/"), -1)
    return (
        F.when(column == "transcript_text", "full transcript (no retrieval)")
        .when(column == "baseline_utterances", "first-K utterances (no retrieval)")
        .when((column == "retrieved_utterances") & F.contains(name, F.lit("full_bm25")), "BM25 (utterance retrieval)")
        .when(column == "retrieved_utterances", "TF-IDF (utterance retrieval)")
        .when(F.contains(column, F.lit("bm25_pack")), "BM25 (participant-side context windows)")
        .when(F.contains(column, F.lit("hybrid_pack")), "Hybrid: BM25 + semantic (participant-side context windows)")
        .otherwise("unknown")
    )


def model_input(item: Column, evidence: Column, longest: int = 256, special: int = 3) -> Column:
    """struct(text, text_pair) within `longest` words and `special` marks: the item stays whole, the evidence is cut. A blank item gives null."""
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    room = F.greatest(F.lit(longest - special) - F.size(words(item)), F.lit(0))
    return F.when(F.trim(F.coalesce(item, F.lit(""))) != "", F.struct(item.alias("text"), F.array_join(F.slice(words(evidence), F.lit(1), room), " ").alias("text_pair")))


def chat_prompt(system: Column, user: Column) -> Column:
    """A system and a user message in one instruction prompt."""
    return F.concat(F.lit("[INST] <<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), user, F.lit(" [/INST]"))


def few_shot_prompt(system: Column, examples: Column, user: Column) -> Column:
    """A chat prompt with worked examples, an array of struct(user, answer), before the question; without any it is chat_prompt()."""
    turns = F.transform(F.coalesce(examples, F.array().cast("array<struct<user:string,answer:string>>")), lambda e: F.concat(e["user"], F.lit(" [/INST] "), e["answer"], F.lit(" </s><s>[INST] ")))
    return F.concat(F.lit("[INST] <<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), F.array_join(turns, ""), user, F.lit(" [/INST]"))


def masked_example(prompt: Column, target: Column, longest: int = 700, ignore: int = -100) -> Column:
    """struct(input_ids, labels) for training on the target alone: whitespace tokens hashed, prompt labels ignored."""
    ids = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.crc32(w.cast("binary")))
    p, t = ids(prompt), ids(target)
    return F.struct(F.slice(F.concat(p, t), 1, longest).alias("input_ids"), F.slice(F.concat(F.transform(p, lambda _: F.lit(ignore).cast("long")), t), 1, longest).alias("labels"))
