"""runweave.streaming"""
