"""panelwright.plans"""
