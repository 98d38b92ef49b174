"""Column names of the two measured data sets, from their sources' numbering to plain names."""

RESPIRATION = {"Time [s]": "time", "RESP": "respiration", "PLETH": "ppg", "II": "ecg_ii", "V": "ecg_v", "AVR": "ecg_avr"}

#: Measurements 1 to 41 of the process, in order.
MEASUREMENTS = """a_feed d_feed e_feed a_and_c_feed recycle_flow reactor_feed_rate reactor_pressure reactor_level reactor_temperature purge_rate
separator_temperature separator_level separator_pressure separator_underflow stripper_level stripper_pressure stripper_underflow
stripper_temperature stripper_steam_flow compressor_work reactor_cooling_water_outlet_temp separator_cooling_water_outlet_temp
component_a_purge component_b_purge component_c_purge component_d_purge component_e_purge component_f_purge component_g_purge component_h_purge
component_d_product component_e_product component_f_product component_g_product component_h_product reactor_feed_composition_a
reactor_feed_composition_b reactor_feed_composition_c reactor_feed_temperature reactor_cooling_water_inlet_temp
separator_cooling_water_inlet_temp""".split()

#: Manipulated variables 1 to 11, in order.
VALVES = """d_feed_valve e_feed_valve a_feed_valve a_and_c_feed_valve compressor_recycle_valve purge_valve separator_underflow_valve
stripper_underflow_valve stripper_steam_valve reactor_cooling_water_valve condenser_cooling_water_valve""".split()

PROCESS = {f"xmeas_{k}": n for k, n in enumerate(MEASUREMENTS, 1)} | {f"xmv_{k}": n for k, n in enumerate(VALVES, 1)}
