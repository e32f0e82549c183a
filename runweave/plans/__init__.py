"""runweave.plans"""
