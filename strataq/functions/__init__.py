"""strataq.functions"""
