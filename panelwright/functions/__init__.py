"""panelwright.functions"""
