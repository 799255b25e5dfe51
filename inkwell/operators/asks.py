"""Messages that ask for a meeting: what they ask, and the state of a talk over several of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Seconds that a remembered place holds, and a question or an answer that a message may refer to.
PLACE_FOR, TALK_FOR = 30 * 86400, 30 * 60
#: Meetings of a reply; MORE asks for the next ones.
SHOWN = 3
#: A table of places is broadcast up to so many rows.
BROADCAST_PLACES = 200_000

# What a message about a meeting looks like, when it is about, whom, where, and what is no place.
MEETING = r"(?i)\b(?:meet(?:ing|ings|in|ins|n)|mtgs?)\b"
SEEKING = (
    r"(?i)\b(?:where(?:'?s|s| is| are| can)?|find|any|anything|next|nearest|closest|near(?:by)?|around|close by|"
    r"local|need|looking|is there|are there|know (?:of|a|any)|got a|show me|list|open|soon|asap)\b"
)
TIMED = r"(?i)\b(?:tonight|today|tomorrow|now|right now|this (?:morning|afternoon|evening))\b"
TOLD = (
    r"(?i)\b(?:went|was|were|had|got back|came back|just left|left early|last night|yesterday|share|shared|sharing|"
    r"speaker|chair(?:ed|ing)?|home group|what happens|what (?:do|should) i (?:say|do)|how (?:do|should|can) i|"
    r"afraid|scared|nervous|anxious|first (?:ever )?meeting|after the meeting|at the meeting)\b"
)
WITHIN = {
    "tonight": r"(?i)\btonight|this evening\b", "tomorrow": r"(?i)tomorrow", "now": r"(?i)\b(?:right now|now|asap|soon)\b",
    "today": r"(?i)\btoday|this (?:morning|afternoon)\b",
}
FELLOWSHIPS = {"NA": r"(?i)\b(?:na|narcotics)\b", "AA": r"(?i)\b(?:aa|a\.a\.|alcoholics)\b"}
ONLINE = r"(?i)\b(?:online|zoom|virtual)\b"
ZIP = r"\b([0-9]{5})(?:-[0-9]{4})?\b"
PLACE = (
    r"(?i)\b(?:in|near|around|by|close to|at)\s+([A-Za-z][A-Za-z .,'-]{1,60}?)\s*"
    r"(?:\b(?:tonight|today|tomorrow|now|right now|asap|soon|please|this (?:morning|afternoon|evening))\b.*)?[?.!]*$"
)
MENTION = r"\b(?:in|near|around|visiting|staying in|live in|moved to)\s+([A-Z][A-Za-z.'-]+(?:[ ,]+[A-Z][A-Za-z.'-]+){0,3})"
FILLER = r"(?i)^(?:i'?m|i am|im|we'?re|it'?s|its|in|near|around|at|just|um+|uh+|ok(?:ay)?|sure)\b[\s,]*"
URGENT = (
    r"(?i)\b(?:about to (?:drink|use)|going to (?:drink|use)|want to (?:drink|use)|wanna (?:drink|use)|"
    r"(?:drink|use|relapse)\w* (?:right )?now|can'?t stop|craving|suicid\w*|kill (?:my|him|her)self|hurt myself)\b"
)
MORE = r"(?i)^\s*(?:more|others?|any (?:more|others)|next(?: ones?)?|what else|keep going)\s*[?.!]*\s*$"
NEAR = r"(?i)^\s*(?:in|near|around)\b"
NO_PLACE = ["me", "here", "my area", "the area", "my town", "town", "you", "the morning", "the evening", "the afternoon", "person", "real life"]
NO_ANSWER = [
    "i", "me", "my", "feel", "feeling", "felt", "want", "need", "help", "sad", "scared", "drink", "drinking", "thanks", "thank", "no", "nope", "nah",
    "never", "nevermind", "cancel", "forget", "yes", "yeah", "ok", "okay", "why", "what", "how", "who", "when", "not", "don't", "dont",
]
NO_MENTION = ["recovery", "program", "the program", "aa", "na", "a.a", "the rooms", "rehab", "treatment", "detox", "sobriety", "step", "steps",
              "meeting", "meetings", "god", "pain", "trouble", "love"]
# States and their short names.
STATES = dict(pair.split("=") for pair in (
    "Alabama=AL,Alaska=AK,Arizona=AZ,Arkansas=AR,California=CA,Colorado=CO,Connecticut=CT,Delaware=DE,District of Columbia=DC,Florida=FL,Georgia=GA,Hawaii=HI,"
    "Idaho=ID,Illinois=IL,Indiana=IN,Iowa=IA,Kansas=KS,Kentucky=KY,Louisiana=LA,Maine=ME,Maryland=MD,Massachusetts=MA,Michigan=MI,Minnesota=MN,Mississippi=MS,"
    "Missouri=MO,Montana=MT,Nebraska=NE,Nevada=NV,New Hampshire=NH,New Jersey=NJ,New Mexico=NM,New York=NY,North Carolina=NC,North Dakota=ND,Ohio=OH,Oklahoma=OK,"
    "Oregon=OR,Pennsylvania=PA,Rhode Island=RI,South Carolina=SC,South Dakota=SD,Tennessee=TN,Texas=TX,Utah=UT,Vermont=VT,Virginia=VA,Washington=WA,"
    "West Virginia=WV,Wisconsin=WI,Wyoming=WY"
).split(","))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _first(text: Column, table: dict[str, str]) -> Column:
    """The name of the first pattern of a table that a text fits."""
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in table.items()])


def _found(text: Column, pattern: str) -> Column:
    """What a pattern's group finds, null for nothing."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _place(text: Column) -> Column:
    named = F.nullif(F.regexp_replace(_found(text, PLACE), r"^[ ,.'-]+|[ ,.'-]+$", ""), F.lit(""))
    return F.coalesce(_found(text, ZIP), F.when(~F.lower(named).isin(NO_PLACE) & ~named.rlike(MEETING), named))


def ask(text: Column) -> Column:
    """What a message asks for: struct(within, fellowship, online, place, urgent); null for other messages."""
    t = F.trim(text)
    asks = t.rlike(MEETING) & ~t.rlike(TOLD) & (t.rlike(SEEKING) | t.rlike(TIMED) | (_words(t) <= 4))
    return F.when(asks, F.struct(
        F.coalesce(_first(t, WITHIN), F.lit("upcoming")).alias("within"), _first(t, FELLOWSHIPS).alias("fellowship"), t.rlike(ONLINE).alias("online"),
        _place(t).alias("place"), t.rlike(URGENT).alias("urgent")))


def answered_place(text: Column) -> Column:
    """The place in a reply to "what city or zip?"; null if the reply is about something else."""
    t = F.trim(text)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, FILLER, ""), FILLER, ""), r"^[ .!?]+|[ .!?]+$", "")
    words = F.regexp_extract_all(F.lower(rest), F.lit("[a-z']+"), F.lit(0))
    fits = F.size(words).between(1, 5) & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NO_ANSWER])) & ~F.lower(rest).isin(NO_PLACE)
    return F.coalesce(_place(t), F.when(fits, rest))


def mentioned_place(text: Column) -> Column:
    """A zip code or a capitalised place that a message mentions; not "in recovery"."""
    named = F.regexp_replace(_found(text, MENTION), r"^[ ,.]+|[ ,.]+$", "")
    return F.coalesce(_found(text, ZIP), F.when(~F.lower(named).isin(NO_MENTION + NO_PLACE), named))


def refinement(text: Column) -> Column:
    """What a short message changes in the last answer: struct(more, within, fellowship, online, place)."""
    t = F.trim(text)
    place = F.when(t.rlike(ZIP) | t.rlike(NEAR), _place(t))
    return F.when(_words(t) <= 5, F.struct(t.rlike(MORE).alias("more"), _first(t, WITHIN).alias("within"), _first(t, FELLOWSHIPS).alias("fellowship"), t.rlike(ONLINE).alias("online"), place.alias("place")))


def short_label(label: Column) -> Column:
    """"94110, San Francisco, California" as "San Francisco, CA"."""
    parts = F.filter(F.transform(F.split(label, ","), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.when((F.size(parts) > 1) & parts[0].rlike(r"^[0-9]{5}(-[0-9]{4})?$"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    states = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    short = F.array_join(F.transform(F.slice(parts, F.lit(1), F.lit(2)), lambda p: F.coalesce(states[p], p)), ", ")
    return F.when(short != "", short).otherwise(label)


def cut(text: Column, most: int) -> Column:
    """Blanks run together; a text over `most` characters ends in an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(most - 1))), F.lit("…")))


def clock12(minute: Column) -> Column:
    """Minutes of the day as people say them: 7:05 PM."""
    hour = F.floor(minute / 60).cast("int")
    return F.format_string("%d:%02d %s", F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("int"), (minute % 60).cast("int"), F.when(hour >= 12, "PM").otherwise("AM"))


def meeting_line(name: Column, fellowship: Column, day: Column, minute: Column, venue: Column, address: Column, miles: Column, now_day: Column, now_minute: Column) -> Column:
    """A reply's line: when it starts, its name, where, and how far."""
    days = F.array(*[F.lit(d) for d in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")])
    until = F.pmod((day - now_day) * 1440 + minute - now_minute, F.lit(7 * 1440))
    clock = clock12(minute)
    when = (
        F.when(until == 0, F.concat(F.lit("starting now ("), clock, F.lit(")"))).when(until <= 60, F.concat(F.lit("in "), until.cast("string"), F.lit(" min ("), clock, F.lit(")")))
        .when(day == now_day, F.concat(clock, F.when(minute >= 17 * 60, " tonight").otherwise(" today")))
        .when(day == (now_day + 1) % 7, F.concat(clock, F.lit(" tomorrow"))).otherwise(F.concat_ws(" ", clock, F.get(days, day)))
    )
    hall, street = cut(venue, 30), cut(F.split(F.coalesce(address, F.lit("")), ",")[0], 30)
    where = F.when((street != "") & (F.lower(street) != F.lower(hall)), F.concat_ws(", ", F.nullif(hall, F.lit("")), street)).otherwise(hall)
    head = F.concat(when, F.lit(": "), cut(name, 36), F.lit(" ("), F.coalesce(fellowship, F.lit("AA")), F.lit(")"))
    return F.concat_ws(", ", head, F.nullif(where, F.lit("")), F.concat(F.regexp_replace(miles.cast("string"), r"\.0$", ""), F.lit(" mi")))


def read(messages: DataFrame, places: DataFrame) -> DataFrame:
    """Messages (phone, at in seconds, text, area) with all that the talk needs: the ask, the answer, the refinement, a mention, and
    the labels of the places in them. places: key (a name or zip code in lower case), label."""
    rows = messages.select("phone", "at", "text", ask(F.col("text")).alias("ask"), answered_place(F.col("text")).alias("answer"), refinement(F.col("text")).alias("change"),
                           mentioned_place(F.col("text")).alias("mention"), "area").withColumn("row", F.monotonically_increasing_id())
    small = places.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    for column in ("ask.place", "answer", "change.place", "mention", "area"):
        name = column.split(".")[0] + "_label"
        known = places.select(F.col("key").alias("_key"), F.col("label").alias(name))
        # where the table is joined by shuffle, rows without a place are dealt out by a key of their own
        key = F.coalesce(F.lower(F.col(column)), F.concat(F.lit("\x00"), F.col("row").cast("string")))
        rows = rows.withColumn("_key", key).join(F.broadcast(known) if small else known, "_key", "left").drop("_key")
    return rows.drop("row")


def fold(state: dict, m: dict) -> tuple[dict, dict | None]:
    """One message: the state after it, and the reply (None: the message goes to the ordinary conversation).

    state: waiting (an ask without a place) and answered (the last ask), each with the second until which it holds; place, the remembered
    one; mention, the last known place that was mentioned. A guessed place is never remembered.
    """
    now = m["at"]
    state = {k: v for k, v in state.items() if v["until"] > now}
    hold = lambda value, seconds: {"value": value, "until": now + seconds}
    seen = {**state, "mention": hold(m["mention_label"], PLACE_FOR)} if m["mention_label"] else state

    def without(s: dict, *names: str) -> dict:
        return {k: v for k, v in s.items() if k not in names}

    request = None
    if m["ask"] is not None:
        request = {**m["ask"], "label": m["ask_label"], "skip": 0, "guessed": False}
    elif "waiting" in state:
        if m["answer"] is None:
            return without(seen, "waiting"), None
        request = {**state["waiting"]["value"], "place": m["answer"], "label": m["answer_label"]}
    elif "answered" in state and m["change"] is not None:
        last, new = state["answered"]["value"], m["change"]
        if new["more"]:
            request = {**last, "skip": last["skip"] + SHOWN, "urgent": False}
        elif new["within"] or new["fellowship"] or new["online"] or new["place"]:
            moved = new["place"] is not None
            request = {
                "within": new["within"] or last["within"], "fellowship": new["fellowship"] or last["fellowship"], "online": new["online"], "urgent": False, "skip": 0,
                "place": new["place"] if moved else last["place"], "label": m["change_label"] if moved else last["label"], "guessed": last["guessed"] and not moved,
            }
    if request is None:
        return seen, None

    def reply(kind: str, **more) -> dict:
        shown = {k: request[k] for k in ("within", "fellowship", "online", "urgent", "skip")}
        return {"kind": kind, **shown, "place": None, "guess": None, "saved": False, **more}

    if request["online"]:
        return {**without(seen, "waiting"), "answered": hold(request, TALK_FOR)}, reply("online")
    guess = None
    if request["place"] is not None and request["label"] is None:
        return {**seen, "waiting": hold({**request, "place": None}, TALK_FOR)}, reply("unknown place", place=request["place"])
    if request["place"] is None:
        if "place" in state:
            request = {**request, **state["place"]["value"]}
        elif "mention" in state:
            guess, request = "mention", {**request, "place": state["mention"]["value"], "label": state["mention"]["value"]}
        elif m["area_label"]:
            guess, request = "area", {**request, "place": m["area"], "label": m["area_label"]}
        else:
            return {**seen, "waiting": hold(request, TALK_FOR)}, reply("which place")
    request["guessed"] = guess is not None or request["guessed"]
    after = {**without(seen, "waiting"), "answered": hold(request, TALK_FOR)}
    saved = not request["guessed"] and "place" not in state
    if not request["guessed"]:
        after["place"] = hold({"place": request["place"], "label": request["label"]}, PLACE_FOR)
    return after, reply("meetings", place=request["label"], guess=guess, saved=saved)


REPLIES = "at long, text string, kind string, within string, fellowship string, online boolean, urgent boolean, skip int, place string, guess string, saved boolean"
NEEDED = ["phone", "at", "text", "ask", "answer", "change", "mention_label", "ask_label", "answer_label", "change_label", "area", "area_label"]


def _plain(frame: pd.DataFrame) -> Iterator[dict]:
    for row in frame.to_dict("records"):
        clean = {k: (None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v) for k, v in row.items()}
        for name in ("ask", "change"):
            clean[name] = None if clean[name] is None else {k: (None if v is None else v) for k, v in (clean[name].asDict() if hasattr(clean[name], "asDict") else dict(clean[name])).items()}
        yield clean


def _schema(rows: DataFrame) -> StructType:
    return StructType([rows.schema["phone"], *StructType.fromDDL(REPLIES).fields])


def replies(rows: DataFrame) -> DataFrame:
    """A row per message of `read` that gets a reply, folded phone by phone in the order of time.

    Messages stream through sorted partitions: a task holds one phone's state, never its messages. Messages of a second go by text.
    """
    schema = _schema(rows)
    dealt = rows.select(NEEDED).repartition("phone").sortWithinPartitions("phone", "at", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phone, state = None, {}
        for frame in frames:
            out = []
            for m in _plain(frame):
                if phone != (m["phone"],):
                    phone, state = (m["phone"],), {}
                state, said = fold(state, m)
                if said:
                    out.append({"phone": m["phone"], "at": m["at"], "text": m["text"], **said})
            yield pd.DataFrame(out, columns=schema.names)

    return dealt.mapInPandas(run, schema)


def reply_stream(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same on a stream of `read` rows with an event time `ts`: the state goes when the last thing in it does.

    A batch's messages of a phone are taken in order of time; the watermark bounds how late a message may come.
    """
    schema = _schema(rows)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = json.loads(state.get[0]) if state.exists else {}, []
        for m in sorted((m for f in frames for m in _plain(f)), key=lambda m: (m["at"], m["text"] or "")):
            now, said = fold(now, m)
            if said:
                out.append({"phone": m["phone"], "at": m["at"], "text": m["text"], **said})
        if now:
            state.update((json.dumps(now, default=bool),))
            state.setTimeoutTimestamp(max(max(v["until"] for v in now.values()) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=schema.names)

    keyed = rows.withWatermark("ts", late).select(*NEEDED, "ts").groupBy("phone")
    return keyed.applyInPandasWithState(step, schema, "talk string", "append", GroupStateTimeout.EventTimeTimeout)
