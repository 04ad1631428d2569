"""Text functions on columns; all run in the JVM unless the name says ``udf``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUBBLE = "※"
BUBBLE_ALIAS = "<|bubble|>"
MEDIA_MARK = "[attachment]"
MAX_BUBBLES, COPY_CHARS = 4, 20
# Replies that only acknowledge.
ACKS = (
    "ok", "k", "kk", "okay", "ok.", "okay.", "lol", "lmao", "haha", "ha", "hahaha",
    "yeah", "yea", "yep", "yup", "yes", "ya", "no", "nah", "nope", "np", "ty", "thanks", "thank you",
    "sure", "bet", "word", "nice", "cool", "true", "facts", "same",
    "sounds good", "ok sounds good", "okay sounds good", "omg", "wow",
    "👍", "👌", "😂", "❤️", "💕", "🔥",
)
# Words that no phrase starts or ends with, words too light to make one, short forms taken as stop words.
PHRASE_EDGES = "to of a an the and is it its we as in on at be can will would could or if that this but not what when how did was were have has had me".split()
PHRASE_LIGHT = "get got go going come make take need want".split()
SHORT_FORMS = "im ive id ill youre thats dont doesnt didnt cant wont theyre weve youve gonna wanna gotta ur would could also us".split()
# English function words that word statistics leave out, besides the short forms.
FUNCTION_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
STOP_WORDS = tuple(dict.fromkeys([*FUNCTION_WORDS, *SHORT_FORMS]))
# Patterns of text that is no reply, and of what is masked. Order matters for masking.
TAPBACK_QUOTE = (
    r"(?isU)^(Loved|Liked|Disliked|Laughed at|Emphasized|Questioned|Reacted(?: with \S+)?|"
    r"Removed (?:a )?(?:like|love|laugh|emphasis|question mark|reaction))\s+[“\"'].+[”\"']$"
)
TAPBACK_BARE = r"(?isU)^(Loved|Liked|Disliked|Laughed at|Emphasized|Questioned)\s+(an?|your|my)\s+\S+"
UNSENT = r"(?isU)^(you )?unsent a message\.?$|^this message was (deleted|unsent)\.?$"
MASKS = (
    ("[email]", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("[password]", r"(?i)\b(?:password|passwd|passcode|pin|otp|2fa code|verification code|login code|auth code)\b[:\s#]*\S+"),
    ("[card]", r"(?<!\d)(?:\d[ \-]*){13,19}(?!\d)"),
    ("[phone]", r"(?<!\d)(?:\+1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]\d{4}(?!\d)"),
    (
        "[address]",
        r"(?i)\b\d{1,5}\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?\s+"
        r"(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Ln|Lane|Dr|Drive|Ct|Court|Way|Hwy|Highway)\.?\b",
    ),
)
# Marks of a model's scaffold, links alone, codes alone, what word statistics take for links, mails and words, and emoji.
SCAFFOLD = r"(?s)<think>.*?</think>|</?think>|<tool_call>.*?</tool_call>|</?tool_call>|<\|im_start\|>|<\|im_end\|>"
LINK_ONLY, CODE_ONLY = r"(?iU)^https?://\S+$", r"^\d{4,8}$"
VOICE_LINK, VOICE_MAIL, VOICE_WORD = r"https?://\S+|www\.\S+", r"\b[\w.+-]+@[\w.-]+\.\w+\b", r"[a-z][a-z']+"
EMOJI = r"[\x{1f300}-\x{1faff}\x{2700}-\x{27bf}\x{1f1e0}-\x{1f1ff}]+"
_PLACEHOLDER = r"\[(?:phone|email|code|password|card|address)\]"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def attributed_text(body: Column) -> Column:
    """The string inside a serialised attributed body: after the NSString mark, a one-byte length or 0x81 and two bytes.

    Bytes are handled as Latin-1 characters, one each; malformed bodies give null.
    """
    raw = F.decode(body, "ISO-8859-1")
    at = F.instr(raw, "NSString")
    rest = F.when(at > 0, F.substr(raw, at + F.lit(len("NSString") + 5)))
    code = lambda k: F.ascii(F.substr(rest, F.lit(k), F.lit(1)))
    long = code(1) == 0x81
    size, start = F.when(long, code(2) + code(3) * 256).otherwise(code(1)), F.when(long, F.lit(4)).otherwise(F.lit(2))
    found = F.substr(rest, start, size)
    return F.when((F.length(rest) > 0) & (size > 0), F.make_valid_utf8(F.encode(found, "ISO-8859-1").cast("string")))


def message_text(text: Column, body: Column) -> Column:
    """The text column, else the decoded body, without object marks and outer white space; null if nothing is left."""
    whole = F.coalesce(F.nullif(text, F.lit("")), attributed_text(body))
    return F.nullif(strip(F.translate(whole, "￼", "")), F.lit(""))


def phone_key(c: Column) -> Column:
    return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))


def handle_key(c: Column) -> Column:
    """A typed key for a phone number or address: the last ten digits, or the address in lower case."""
    return F.when(F.contains(c, F.lit("@")), F.concat(F.lit("email:"), F.lower(strip(c)))).when(phone_key(c) != "", F.concat(F.lit("phone:"), phone_key(c)))


def person_id(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("me")).isin("", "me"), "me").otherwise(F.left(F.sha1(key), F.lit(16)))


def is_person_id(c: Column) -> Column:
    return c.rlike("(?i)^[0-9a-f]{16}$")


def colour_of(name: Column, colours: int = 8) -> Column:
    """A colour number from the sum of code points."""
    letters = F.filter(F.split(text_or_empty(name), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda n, x: n + F.ascii(x)) % colours


def split_bubbles(c: Column) -> Column:
    parts = F.split(F.replace(text_or_empty(c), F.lit(BUBBLE_ALIAS), F.lit(BUBBLE)), BUBBLE)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def join_bubbles(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), BUBBLE)


def clip_bubbles(c: Column, most: int = MAX_BUBBLES) -> Column:
    return F.array_join(F.slice(split_bubbles(c), 1, most), BUBBLE)


def strip_scaffold(c: Column) -> Column:
    """Without template tokens and what thinking or tool tags enclose."""
    return strip(F.regexp_replace(text_or_empty(c), SCAFFOLD, ""))


def is_artifact(c: Column) -> Column:
    """Tapback summaries and unsent notices."""
    t = strip(text_or_empty(c))
    return (t != "") & (t.rlike(TAPBACK_QUOTE) | t.rlike(TAPBACK_BARE) | t.rlike(UNSENT))


def is_media_only(c: Column) -> Column:
    parts = split_bubbles(c)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p == MEDIA_MARK)


def _flat(c: Column) -> Column:
    return strip(F.replace(text_or_empty(c), F.lit(BUBBLE), F.lit(" ")))


def is_link_only(c: Column) -> Column:
    return _flat(c).rlike(LINK_ONLY)


def is_low_signal(c: Column) -> Column:
    """Blank, an acknowledgement with or without punctuation, or at most two words and twelve characters."""
    t = _flat(c)
    plain = strip(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]+", ""))
    return (t == "") | t.isin(*ACKS) | plain.isin(*ACKS) | ((F.size(F.split(t, r"(?U)\s+")) <= 2) & (F.char_length(t) <= 12))


def is_ack(c: Column) -> Column:
    """Nothing but an acknowledgement."""
    return F.regexp_replace(F.lower(strip(text_or_empty(c))), r"^[.!,]+|[.!,]+$", "").isin(*ACKS)


def redact(c: Column) -> Column:
    """Masks by bubble: a bubble of four to eight digits is a code; then addresses, secrets, cards, phones and streets."""

    def one(part: Column) -> Column:
        out = part
        for mask, pattern in MASKS:
            out = F.regexp_replace(out, pattern, mask)
        return F.when(strip(part).rlike(CODE_ONLY), F.lit("[code]")).otherwise(out)

    return F.array_join(F.transform(F.split(c, BUBBLE), one), BUBBLE)


def contains_redaction(c: Column) -> Column:
    return text_or_empty(c).rlike(_PLACEHOLDER)


def is_redaction_only(c: Column) -> Column:
    t = strip(text_or_empty(c))
    return (strip(F.replace(t, F.lit(BUBBLE), F.lit(""))) == "") | t.rlike(rf"^(?:{_PLACEHOLDER}(?:\s*{BUBBLE}\s*)?)+$")


def voice_tokens(c: Column) -> Column:
    """Lower-case words of a to z and apostrophes, two characters at least, then without apostrophes; links and addresses do not count."""
    t = F.regexp_replace(F.translate(F.lower(text_or_empty(c)), "’", "'"), VOICE_LINK, " ")
    t = F.regexp_replace(t, f"(?U){VOICE_MAIL}", " ")
    words = F.transform(F.regexp_extract_all(t, F.lit(VOICE_WORD), F.lit(0)), lambda w: F.replace(w, F.lit("'"), F.lit("")))
    return F.filter(words, lambda w: w != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[a-z0-9']+"), F.lit(0))


def name_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)


def emoji_runs(c: Column) -> Column:
    """Runs of emoji; a run counts once."""
    return F.regexp_count(text_or_empty(c), F.lit(EMOJI))


def copied_from_prompt(reply: Column, prompt: Column) -> Column:
    t = strip(text_or_empty(reply))
    return (F.char_length(t) >= COPY_CHARS) & F.contains(text_or_empty(prompt), t)


#: Fixed value: how a labelled message begins.
LABELLED = r"^[^\n:]{1,24}: "


def sender_label(name: Column) -> Column:
    """The first word of a name, 24 characters at most; null without one."""
    return F.nullif(F.left(F.regexp_extract(text_or_empty(name), r"\S+", 0), F.lit(24)), F.lit(""))


def label_sender(content: Column, label: Column) -> Column:
    """``Label: text``, unless there is no label or the text begins like a labelled one."""
    return F.when(label.isNotNull() & ~F.regexp(content, F.lit(LABELLED)), F.concat(label, F.lit(": "), content)).otherwise(content)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
