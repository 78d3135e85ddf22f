"""Plans that put operators together: proxy training, strategies, schedules, the query catalog."""
