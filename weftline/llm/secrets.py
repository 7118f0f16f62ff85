"""Secret scans: fixed patterns, and candidates that a dictionary-primed compressor finds novel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import read_table

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What makes a place sensitive; a candidate follows or precedes it within ``near`` characters.
_CONTEXT = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|apikey|auth(?:orization)?|bearer|credential|private[_ -]?key|access[_ -]?key|client[_ -]?id|signature|session[_ -]?id|connection[_ -]?string|sas[_ -]?key|encryption[_ -]?key", re.IGNORECASE)
#: Where a candidate may lie, and in it whole runs of base64, identifiers and dotted tokens; "=" pads them at their end.
_STRETCH = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_LEAST = 16
#: Characters that the longest sensitive word may have.
_WORD_ROOM = 24
#: Names and words of code and configuration: what a string in a sensitive place often is when it is no secret.
IDENTIFIERS = (
    "access_key access_token account_id accountName add_header admin administrator algorithm allow_origin api_key api_version apiVersion application/json application_name applicationProperties "
    "argument arguments array assert async authentication authenticate authorization AuthorizationHeader authorizationServer authService await aws_access_key_id aws_secret_access_key base64 basic bearer "
    "boolean branch broker bucket_name buffer build builder callback cache certificate changeme change_me channel charset checksum class client_id client_secret clientCredentials clientSecret collection "
    "column com.example.application config configuration connection connection_string connectionTimeout console const constructor container content-type context controller cookie count create created_at "
    "credentials credentialsProvider cursor customer data database database_password database_url DATABASE_PASSWORD date datetime db_name db_password db_user debug decode default default_password "
    "delete description destination development dictionary digest directory document domain download dummy element email enabled encode encoding encrypt encryption_key endpoint environment error event "
    "example example.com example_password examplePassword exception execute export expires_in false field file filename filter final float format forgot_password forgotPassword function generate "
    "getAccessToken getAuthorizationToken getElementById getenv getPassword getSecretValue grant_type github google handler hash header headers heroku hostname http https identifier import include index "
    "initialize input insert instance int integer interface internal invalid_token InvalidCredentialsException iterator java javascript json jsonwebtoken key keyboard keystore kubernetes lambda language length library "
    "license list listener local localhost location logger login logout lorem ipsum manager mapping message metadata method middleware migration mock model module mongodb mysql name namespace new_password next "
    "node none notification null number oauth oauth2 object operation option organization os.environ output override package parameter params parse password password_confirmation passwordConfirmation "
    "PasswordEncoder password_hash password_reset_token passwordResetToken path payload permission placeholder plain platform policy port postgres postgresql prefix primary_key print private private_key processor "
    "process.env production profile project property protected protocol provider proxy public public_key python query queue random readonly record redirect_uri redis reference refresh_token refreshToken region "
    "register registry release remote repository request require resource response response_type rest result return role root route router sample schema scope script search secret secret_key SECRET_KEY "
    "secretKeyRef security select sequence serializer server service session session_id sessionToken setPassword settings shared_secret signature signing_key simple socket source spring staging standard start "
    "state static status storage store stream string struct subject submit subscription success suffix system table target template temporary tenant test test_password testPassword text thread timeout timestamp "
    "title token token_type tokenizer transaction transport true type undefined unauthorized unicode update upload uri url user user_id user_password username userPassword users utf-8 uuid validate validation "
    "valueFrom value variable vault verification version view virtual void warning web webhook website window worker workspace write xml yaml your_api_key_here your_password_here YOUR_API_KEY yourpassword "
    "your-secret-key your_token_here _builder _cache _client _cluster _handler _loader _manager _model _node _of_ _for_ _to_ _with_ _limit _worker v1 v2 v3 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx 0000000000000000 ---------------- ================"
)


class Novelty:
    """Bytes that a candidate adds when it is compressed after its surroundings."""

    def __init__(self, words: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def share(self, around: str, candidate: str) -> float:
        """Marginal compressed bytes per byte of the candidate; ``around`` is what stands next to it.

        The less of the text as it is and in lower case, so that names of several words count as
        those words, however they are joined.
        """
        found = []
        for before, own in ((around, candidate), (around.lower(), candidate.lower())):
            before, own = before.encode(errors="replace") + b"\n", own.encode()
            found.append((len(self.packer.compress(before + own)) - len(self.packer.compress(before))) / len(own))
        return min(found)


@lru_cache(maxsize=4)
def _novelty(words: str) -> Novelty:
    return Novelty(words)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: whole matches, leftmost and non-overlapping by kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def candidates(text: str, near: int) -> list[tuple[int, int]]:
    """(start, end) of runs of 16 or more characters, with a digit and a letter, in a sensitive place.

    A place is sensitive if at most ``near`` characters lie between it and a sensitive word, before
    or after. A word within a run cuts it: what stands before the word is a run, and so is what
    follows it after a sign (``token_x9...``). Where letters or digits follow at once, the word is
    the start of a longer name (``tokenizer_...``) or has the secret stuck to it, and the run from
    the word on is one candidate. Runs are whole otherwise, however long they are.
    """
    found = []
    for stretch in _STRETCH.finditer(text):
        if not _DIGIT.search(text, *stretch.span()):
            continue
        for run in _RUN.finditer(text, *stretch.span()):
            start, end = run.span()
            if end - start < _LEAST:
                continue
            words = [m.span() for m in _CONTEXT.finditer(text, max(0, start - near - _WORD_ROOM), end + near + _WORD_ROOM)]
            parts, cut = [], start
            for first, last in words:
                if last <= start or first >= end:
                    continue
                if first > cut:
                    parts.append((cut, first))
                glued = last < end and text[last].isalnum()
                cut = max(cut, first if glued else last + (last < end and text[last] in "_-./+"))
            parts.append((cut, end))
            for s, e in parts:
                near_word = any(last >= s - near and first <= e + near for first, last in words)
                if e - s >= _LEAST and near_word and _DIGIT.search(text, s, e) and _LETTER.search(text, s, e):
                    found.append((s, e))
    return found


def novel_spans(text: str, near: int = 48, around: int = 200, least: float = 0.72, identifiers: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Candidates whose marginal compressed size is ``least`` or more of their own.

    Each candidate is measured after ``around`` characters on either side of it and the dictionary
    of ``identifiers``, whether or not a fixed pattern has found it too.
    """
    measure = _novelty(identifiers)
    return [(s, e, "novel") for s, e in candidates(text, near) if measure.share(text[max(0, s - around) : s] + text[e : e + around], text[s:e]) >= least]


def _scan(batches: Iterator[pa.RecordBatch], near: int, around: int, least: float, identifiers: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            spans = []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text) + novel_spans(text, near, around, least, identifiers)
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k in sorted(own, key=lambda s: (s[0], KINDS.index(s[2])))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 48, around: int = 200, least: float = 0.72, identifiers: str = IDENTIFIERS) -> DataFrame:
    """``(<id_col>, spans)``: a row per document, its spans (kind, start, end) by start, then kind.

    Places count code points; ends are exclusive. The kinds assign, access and hex are fixed
    patterns, novel is what the compressor finds, in their matches too; ``identifiers`` is its
    dictionary, which a corpus may have of its own. A text is read whole and each row alone. A null text is an empty one and has no spans; null and
    repeated ids are passed on; extra columns are left out; an empty table gives an empty result.
    """
    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))])
    return plain.mapInArrow(partial(_scan, near=near, around=around, least=least, identifiers=identifiers), schema).withColumnRenamed("id", id_col)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``; odd rows as in ``secret_spans``."""
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}
SQL: dict = {}
