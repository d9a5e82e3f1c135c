"""Schemas of the collections and the defaults that reading fills in."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _L = T.StringType(), T.BooleanType(), T.LongType()


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BACK = _of(style=_S, color=_S, emblem=_S, motto=_S)
CARD = _of(
    id=_S, user_id=_S, type=_S, custom_type=_S, name=_S, description=_S, story=_S, language=_S, attributes=_S,
    artwork_path=_S, back=BACK, created_at=_S, updated_at=_S,
)
USER = _of(
    user_id=_S, email=_S, name=_S, picture=_S, auth_provider=_S, is_admin=_B, premium_manual=_B, premium_until=_S,
    password_hash=_S, created_at=_S, stripe_subscription_id=_S, stripe_customer_id=_S,
)
SESSION = _of(user_id=_S, session_token=_S, expires_at=_S, created_at=_S)
FILE = _of(id=_S, storage_path=_S, user_id=_S, original_filename=_S, content_type=_S, is_deleted=_B, created_at=_S)
TRANSACTION = _of(
    session_id=_S, user_id=_S, lookup_key=_S, amount=_L, currency=_S, status=_S, payment_status=_S, created_at=_S, updated_at=_S
)
#: created: seconds since 1970.
EVENT = _of(
    id=_S, created=_L, type=_S,
    data=_of(object=_of(id=_S, payment_status=_S, metadata=_of(user_id=_S), subscription=_S, customer=_S)),
)

# Defaults of missing fields.
CARD_DEFAULTS = {
    "custom_type": "", "name": "", "description": "", "story": "", "language": "it", "attributes": "{}",
    "back": {"style": "classic", "color": "#7f1d1d", "emblem": "flame", "motto": ""},
}
USER_DEFAULTS = {"auth_provider": "email", "is_admin": False, "premium_manual": False}
