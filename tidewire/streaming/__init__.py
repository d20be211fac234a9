from .narratives import latest, narratives, run_to_files, run_to_tables
from .volumes import dedup_stream, read_event_stream, session_volumes, tumbling_volumes

__all__ = ["dedup_stream", "latest", "narratives", "read_event_stream", "run_to_files", "run_to_tables", "session_volumes", "tumbling_volumes"]
