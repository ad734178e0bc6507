from panelkit.streaming.weekly import latest_weekly, run_weekly, stream_weekly

__all__ = ["latest_weekly", "run_weekly", "stream_weekly"]
