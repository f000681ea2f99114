"""panelwright.operators"""
