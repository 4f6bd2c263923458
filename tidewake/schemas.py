"""Record schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 1


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()

# The fields a stored record keeps.
POST = _struct(
    id=_S, created_utc=_L, author=_S, author_fullname=_S, title=_S, selftext=_S, score=_L, upvote_ratio=_D, num_comments=_L, subreddit=_S,
    link_flair_text=_S, is_self=_B, distinguished=_S, stickied=_B, locked=_B, over_18=_B, removed_by_category=_S, domain=_S, url=_S, permalink=_S,
)
COMMENT = _struct(
    id=_S, created_utc=_L, author=_S, author_fullname=_S, body=_S, score=_L, link_id=_S, parent_id=_S, subreddit=_S,
    distinguished=_S, stickied=_B, controversiality=_L, is_submitter=_B,
)
THREAD = _struct(id=_S, title=_S, created_utc=_L, thread_type=_S, subreddit=_S, author=_S, score=_L, stickied=_B, distinguished=_S)
#: Tags a pipeline adds to records; any column with this prefix survives projection.
TAG = "_"
COMMENT_TAGGED = T.StructType([*COMMENT.fields, *_struct(_thread_type=_S, _thread_id=_S, _subreddit=_S, _source=_S).fields])
CHART = _struct(
    meta=_struct(firstTradeDate=_L), timestamp=T.ArrayType(_L),
    indicators=_struct(quote=T.ArrayType(_struct(close=T.ArrayType(_D), volume=T.ArrayType(_L))), adjclose=T.ArrayType(_struct(adjclose=T.ArrayType(_D)))),
)
DONE = _struct(unit_key=_S, track=_S, record_count=_L, completed_at=_S)
ISSUE = _struct(id=_L, unit_key=_S, kind=_S, detail=_S, noted_at=_S)
# Texts that stand for withdrawn content.
WITHDRAWN = ("[deleted]", "[removed]")
