"""Declared schemas of the stored and raw tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
DOUBLE, INSTANT = T.DoubleType(), T.TimestampType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def array(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


REACTION = struct(emoji=STRING, count=LONG, users=STRINGS)
FILE = struct(id=STRING, name=STRING, mimetype=STRING, url=STRING, size=LONG)
SPRINT = struct(name=STRING, state=STRING)
TICKET_META = struct(
    ticket_id=STRING, summary=STRING, status=STRING, priority=STRING, assignee=STRING
)

# Column names, types and order of the stored tables.
MESSAGES = struct(
    message_id=STRING,
    user_id=STRING,
    text=STRING,
    timestamp=STRING,
    thread_ts=STRING,
    is_thread_parent=FLAG,
    is_thread_reply=FLAG,
    reply_count=LONG,
    user_name=STRING,
    user_real_name=STRING,
    user_email=STRING,
    user_is_bot=FLAG,
    reactions=array(REACTION),
    files=array(FILE),
    jira_tickets=STRINGS,
    has_reactions=FLAG,
    has_files=FLAG,
    has_thread=FLAG,
)
TICKETS = struct(
    ticket_id=STRING,
    summary=STRING,
    priority=STRING,
    issue_type=STRING,
    status=STRING,
    assignee=STRING,
    due_date=STRING,
    story_points=LONG,
    created=STRING,
    updated=STRING,
    blocks=STRINGS,
    blocked_by=STRINGS,
    depends_on=STRINGS,
    related=STRINGS,
    components=STRINGS,
    labels=STRINGS,
    fix_versions=STRINGS,
    resolution=STRING,
    progress_total=LONG,
    progress_done=LONG,
    progress_percentage=DOUBLE,
    project=STRING,
    team=STRING,
    epic_link=STRING,
    comments=T.MapType(STRING, LONG),
    total_comments=LONG,
    sprints=array(SPRINT),
    cached_at=INSTANT,
)
USERS = struct(
    user_id=STRING,
    user_name=STRING,
    user_real_name=STRING,
    user_email=STRING,
    is_bot=FLAG,
    cached_at=STRING,
)
STAKEHOLDERS = struct(name=STRING, weight=INT, role=STRING, description=STRING)
CHANNELS = struct(name=STRING, id=STRING, description=STRING, signal_type=STRING, tags=STRINGS)

# Raw records, as the chat service and the issue tracker deliver them.
RAW_USER = struct(
    id=STRING, name=STRING, real_name=STRING, is_bot=FLAG, profile=struct(email=STRING)
)
RAW_MESSAGE = struct(
    ts=STRING,
    user=STRING,
    text=STRING,
    thread_ts=STRING,
    reply_count=LONG,
    user_info=RAW_USER,
    reactions=array(struct(name=STRING, count=LONG, users=STRINGS)),
    files=array(struct(id=STRING, name=STRING, url_private=STRING, mimetype=STRING, size=LONG)),
)
_NAMED, _KEYED, _PERSON = struct(name=STRING), struct(key=STRING), struct(displayName=STRING)
RAW_ISSUE = struct(
    key=STRING,
    fields=struct(
        summary=STRING,
        status=_NAMED,
        priority=_NAMED,
        issuetype=_NAMED,
        assignee=_PERSON,
        duedate=STRING,
        customfield_10016=DOUBLE,
        customfield_10020=STRINGS,
        customfield_10021=STRING,
        customfield_10014=STRING,
        created=STRING,
        updated=STRING,
        issuelinks=array(struct(type=_NAMED, outwardIssue=_KEYED, inwardIssue=_KEYED)),
        components=array(_NAMED),
        labels=STRINGS,
        fixVersions=array(_NAMED),
        resolution=_NAMED,
        progress=struct(total=LONG, progress=LONG),
        project=_KEYED,
        comment=struct(comments=array(struct(author=_PERSON))),
    ),
)

# Partition columns are strings and come after the data columns.
MESSAGES_STORED = T.StructType(MESSAGES.fields + struct(dt=STRING, channel=STRING).fields)
#: As files hold messages: with the instant of ``timestamp``, absent in files of older writers.
MESSAGES_FILE = T.StructType(
    MESSAGES.fields + struct(event_ts=INSTANT).fields + struct(dt=STRING, channel=STRING).fields
)
TICKETS_STORED = T.StructType(TICKETS.fields + struct(dt=STRING).fields)
