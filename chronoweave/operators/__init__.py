"""Operators on event, interval and price frames, all of plain DataFrame expressions unless said otherwise."""
