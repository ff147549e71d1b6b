"""Source-corpus review analytics on Spark."""

from reviewlake.operators.topk import keep_where
from reviewlake.packs.own import LanguagePack
from reviewlake.plans.review import issues, review, spread
from reviewlake.session import session, shared_folder, store

__all__ = ["LanguagePack", "review", "issues", "spread", "keep_where", "session", "shared_folder", "store"]
